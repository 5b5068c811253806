"""Registry matching against plain versions: every pair scored, every round walked through."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from worklens.catalog import REGISTRY, callable_for
from worklens.catalog.tables import Tables
from worklens.operators import blocks, matching, names
from worklens.sources import registry_fixtures as reg

SF = "/root/testdata/sf0.001"
OURS = "mp_id string, ls_term int, mp_name string, constituency string, state string, house string"
LOWER = "reg_id int, ls_term int, name string, state string, seat string, status string"


def _choose(member, records, taken):
    """(score, reg_id) that one member claims; records are (reg_id, skey, seat, tokens)."""
    left = [r for r in records if r[0] not in taken]
    _, skey, seat, tokens = member
    scored = sorted((-names.pair_score(tokens, r[3]), r) for r in left)
    state = [(s, r) for s, r in scored if r[1] == skey]
    own = [(s, r) for s, r in state if r[2] == seat]
    pool = own or state
    if pool and (-pool[0][0] >= 0.62 or (len(own) == 1 and -pool[0][0] >= 0.3)):
        return -pool[0][0], pool[0][1][0]
    strong = [(s, r) for s, r in scored if -s >= 0.9]
    return (-strong[0][0], strong[0][1][0]) if len(strong) == 1 else None


def _walk(members, records, repair=True):
    """{mp_id: (reg_id, score)} over all terms; members and records are lists by term."""
    out = {}
    for term, ours in members.items():
        theirs, taken, claim = records.get(term, []), set(), {}
        pending = ours
        while pending:
            for m in pending:
                claim[m[0]] = _choose(m, theirs, taken)
            if not repair:
                break
            held = defaultdict(list)
            for mp_id, c in claim.items():
                if c:
                    held[c[1]].append((-c[0], mp_id))
            lost = set()
            for reg_id, who in held.items():
                if len(who) > 1:
                    taken.add(reg_id)
                    lost |= {mp_id for _, mp_id in sorted(who)[1:]}
            pending = [m for m in ours if m[0] in lost]
        out |= {mp_id: (c[1], round(c[0], 6)) for mp_id, c in claim.items() if c}
    return out


def _plain(ours, roster):
    """Members and records by term, as the operators prepare them."""
    left, right = matching._prepared_lower(ours, roster)
    members, records = defaultdict(list), defaultdict(list)
    for r in left.collect():
        members[r.ls_term].append((r.mp_id, r.skey, r.seat, r.tokens))
    for r in right.collect():
        records[r.ls_term].append((r.reg_id, r.skey, r.seat, r.rtokens))
    return members, records


def _got(df):
    rows = df.collect()
    assert len({r.mp_id for r in rows}) == len(rows)
    return {r.mp_id: (r.reg_id, round(r.score, 6)) for r in rows}


def _drawn(spark, seed, n, seats, states):
    """Few syllables and few seats: namesakes, crowded seats, lone ones and moved members."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice(["ra", "me", "sh", "ku", "an"]) for _ in range(draw.choice([1, 2, 2, 3])))
    place = lambda: (f"Seat {'abcdefghij'[draw.randrange(seats)]}", f"S{'xyz'[draw.randrange(states)]}")
    people = [f"{word()} {word()}" for _ in range(n)]
    mine, theirs = [], []
    for i in range(n):
        seat, state = place()
        mine.append((f"m{i:03d}", 17 + i % 2, draw.choice(people), seat, state, "Lok Sabha"))
        seat, state = (seat, state) if draw.random() < 0.5 else place()
        theirs.append((i, 17 + i % 2, draw.choice(people), state, seat, "Sitting"))
    mine += [("m900", 17, "(none)", "Seat a", "Sx", "Lok Sabha"), ("m901", 17, None, None, None, "Lok Sabha"),
             ("m902", 18, people[0], None, "Sx", "Lok Sabha"), ("m903", 18, people[1], "Seat a", None, "Rajya Sabha")]
    theirs += [(900, 17, None, "Sx", "Seat a", None), (901, 18, people[2], None, None, None)]
    return spark.createDataFrame(mine, OURS), spark.createDataFrame(theirs, LOWER)


@pytest.mark.parametrize("seed, n, seats, states", [(1, 60, 10, 3), (2, 60, 1, 1), (3, 40, 10, 1), (4, 90, 3, 2)])
def test_matches_equal_a_walk_through_the_rounds(spark, monkeypatch, seed, n, seats, states):
    monkeypatch.setattr(blocks.compare_blocks, "__defaults__", (16,))
    ours, roster = _drawn(spark, seed, n, seats, states)
    members, records = _plain(ours, roster)
    assert _got(matching.match_lower(ours, roster)) == _walk(members, records, repair=False)
    wanted = _walk(members, records)
    got = matching.resolve_contested(ours, roster)
    assert _got(got) == wanted and wanted
    assert got.groupBy("ls_term", "reg_id").count().filter("count > 1").count() == 0


def test_matching_empty_registries(spark):
    ours, roster = _drawn(spark, 5, 12, 3, 2)
    assert matching.resolve_contested(ours, roster.limit(0)).count() == 0
    assert matching.resolve_contested(ours.limit(0), roster).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=70), st.lists(st.text("abcd ", max_size=90), min_size=1, max_size=8),
       st.sampled_from([0.3, 0.62, 0.9]))
def test_pool_scores_lose_nothing(ours, theirs, least):
    got = names.pool_scores(ours, names.Pool(theirs), least)
    for name, score in zip(theirs, got):
        wanted = names.pair_score(ours, name)
        assert score == wanted or (score == 0 and wanted < least)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=14), st.text("ab", min_size=1, max_size=14))
def test_a_ratio_makes_names_share_pairs_of_letters(a, b):
    from collections import Counter
    from difflib import SequenceMatcher
    ratio = SequenceMatcher(None, a, b).ratio()
    grams = [Counter(x[k:k + 2] for k in range(len(x) - 1)) for x in (a, b)]
    need = math.ceil((1.5 * ratio - 1) * (len(a) + len(b)) - 1 - 1e-9)
    assert sum((grams[0] & grams[1]).values()) >= need


@pytest.mark.parametrize("floor", [0.81, 0.9, 0.95])
def test_similar_names_equal_brute_force(spark, floor):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abc") for _ in range(draw.randrange(1, 7)))
    drawn = lambda n: sorted({" ".join(sorted(word() for _ in range(draw.randrange(1, 4)))) for _ in range(n)})
    left, right = drawn(120) + [""], drawn(150) + ["a", ""]
    got = names.similar_names(
        spark.createDataFrame([(k % 2, x) for k, x in enumerate(left)], "k int, tokens string"),
        spark.createDataFrame([(k % 2, x) for k, x in enumerate(right)], "k int, rtokens string"), ["k"], floor)
    found = {(r.k, r.tokens, r.rtokens): r.score for r in got.collect()}
    wanted = {(i % 2, a, b): names.pair_score(a, b) for i, a in enumerate(left) for j, b in enumerate(right)
              if i % 2 == j % 2 and a != b and names.pair_score(a, b) >= floor}
    assert found == wanted and wanted


def test_similar_names_refuse_a_floor_that_grams_cannot_hold(spark):
    df = spark.createDataFrame([(1, "a")], "k int, tokens string")
    with pytest.raises(ValueError):
        names.similar_names(df, df.withColumnRenamed("tokens", "rtokens"), ["k"], 0.8)


@pytest.fixture(scope="module")
def walked(spark):
    ours, lower = reg.our_members(spark, SF), reg.lower_registry(spark, SF)
    members, records = _plain(matching.latest_term_rows(ours), lower)
    return ours.collect(), lower.collect(), reg.upper_registry(spark, SF).collect(), members, records


def _query(spark, name):
    return callable_for(REGISTRY[name])(spark, SF).collect()


def test_match_queries_equal_brute_force(spark, walked):
    _, _, _, members, records = walked
    for name, repair in (("match_lower", False), ("match_one_to_one", True)):
        got = {r.mp_id: (r.reg_id, r.score) for r in _query(spark, name)}
        assert got == _walk(members, records, repair)


def _matched_everywhere(spark, walked):
    """(mp_id, source, reg_id) of the one-to-one lower matches and of the upper ones."""
    _, _, _, members, records = walked
    lower = {(m, matching.LOWER, r[0]) for m, r in _walk(members, records).items()}
    upper = {(r.mp_id, matching.UPPER, r.reg_id) for r in _query(spark, "match_upper")}
    return lower | upper


def test_coverage_query_counts_the_matched(spark, walked):
    ours = {r.mp_id for r in walked[0]}
    hit = {m for m, _, _ in _matched_everywhere(spark, walked)} & ours
    row, = _query(spark, "match_coverage")
    assert (row.members, row.matched, row.enough) == (len(ours), len(hit), len(hit) >= 0.9 * len(ours))


def test_unlisted_queries_equal_brute_force(spark, walked):
    ours, lower, upper, _, _ = walked
    term = {r.mp_id: 0 for r in ours}
    for r in ours:
        term[r.mp_id] = max(term[r.mp_id], r.ls_term)
    used = {(source, reg_id) for m, source, reg_id in _matched_everywhere(spark, walked) if term[m] == 18}
    last = lambda text: int(text.split("-")[1]) % 100 + 2000
    wanted = {f"ls-{r.reg_id}" for r in lower if r.ls_term == 18 and r.status == "Sitting"
              and (matching.LOWER, r.reg_id) not in used}
    wanted |= {f"rs-{r.reg_id}" for r in upper if r.status == "Sitting" and (matching.UPPER, r.reg_id) not in used
               and last(r.term) >= matching.Params.upper_from_year}
    got = _query(spark, "unlisted_members")
    assert {r.id for r in got} == wanted and len(got) == len(wanted)
    tables = Tables(spark, SF)
    listed = tables.members.filter(F.col("ls_term") == 18).select("mp_id").distinct().count()
    row, = _query(spark, "member_count")
    assert max(v for v in row.asDict().values() if isinstance(v, int)) == listed + len(wanted)
    cards = _query(spark, "directory_with_unlisted")
    assert len(cards) == listed + len(wanted)


@settings(max_examples=100, deadline=None)
@given(st.text("abc ", max_size=70), st.lists(st.text("abcd ", max_size=90), min_size=1, max_size=8),
       st.sampled_from([0.3, 0.62, 0.9]), st.integers(1, 3))
def test_pool_best_equals_all_pairs(ours, theirs, least, most):
    more = [0.1 * (k % 2) for k in range(len(theirs))]
    scored = sorted((-(names.pair_score(ours, n) + more[k]), k) for k, n in enumerate(theirs) if ours and n)
    wanted = [(-s, k) for s, k in scored if -s >= least][:most]
    assert names.pool_best(ours, names.Pool(theirs), least, np.array(more), most) == wanted


def test_few_names_are_aligned(monkeypatch):
    """Of many names over the floor only those are aligned that may be the best."""
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("ra me sh ku an lo ti".split()) for _ in range(3))
    pool, met, real = names.Pool([f"{word()} {word()}" for _ in range(1000)]), [], names.Pool.score
    monkeypatch.setattr(names.Pool, "score", lambda p, a, k, o: met.append(k) or real(p, a, k, o))
    asked = [f"{word()} {word()}" for _ in range(20)]
    over = sum((names.pool_scores(a, pool, 0.5) >= 0.5).sum() for a in asked)
    met.clear()
    assert all(names.pool_best(a, pool, 0.5) for a in asked) and len(met) < over / 3


def test_namesakes_with_records_of_their_own_are_settled(spark):
    rows = [("m1", 18, "ra me", "Seat a", "Sx", "Lok Sabha"), ("m2", 18, "ra me", "Seat b", "Sx", "Lok Sabha"),
            ("m3", 18, "ku an", "Seat a", "Sx", "Lok Sabha"), ("m4", 18, "ku an", "Seat a", "Sx", "Lok Sabha")]
    theirs = [(1, 18, "me ra", "Sx", "Seat a", None), (2, 18, "me ra", "Sx", "Seat b", None),
              (3, 18, "an ku", "Sx", "Seat a", None)]
    house = matching._Lower(spark.createDataFrame(rows, OURS), spark.createDataFrame(theirs, LOWER))
    assert sorted((r.mp_id, r.reg_id) for r in house.sure.collect()) == [("m1", 1), ("m2", 2)]
    assert sorted(r.mp_id for r in house.open.collect()) == ["m3", "m4"]


@pytest.mark.parametrize("listed", [1, 2])
def test_a_used_up_list_is_read_on(spark, monkeypatch, listed):
    monkeypatch.setattr(matching._Lower.__init__, "__defaults__", (listed,))
    ours, roster = _drawn(spark, 6, 60, 2, 1)
    assert _got(matching.resolve_contested(ours, roster)) == _walk(*_plain(ours, roster))
