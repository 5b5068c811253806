"""Plain versions of the operators, one text or pair at a time."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def archived(pages):
    by = defaultdict(list)
    for i, html in pages:
        by[(html or "").encode()].append(i)
    out = {}
    for payload, ids in by.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in ids:
            first = i == max(ids)
            out[i] = (len(payload), digest, "response" if first else "revisit",
                      None if first else max(ids))
    return out


def weighted(text):
    found = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(
        rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if len(found) >= 5:
        runs = Counter(tuple(found[k:k + 5]) for k in range(len(found) - 4))
    else:
        runs = Counter([tuple(found)]) if found else Counter([("bytes", text or "")])
    return {(x, k) for x, n in runs.items() for k in range(n)}


def near_classes(rows, threshold=0.8):
    units = {i: weighted(t) for i, t in rows}
    root = {i: i for i in units}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(units)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            shared = len(units[a] & units[b])
            if shared >= threshold * (len(units[a]) + len(units[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def without_repeats(rows, width=20):
    docs = {i: words(t) for i, t in rows}
    first = {}
    for i in sorted(docs):
        for s in range(len(docs[i]) - width + 1):
            first.setdefault(tuple(docs[i][s:s + width]), (i, s))
    out = {}
    for i, own in docs.items():
        gone = set()
        for s in range(len(own) - width + 1):
            if first[tuple(own[s:s + width])] != (i, s):
                gone.update(range(s, s + width))
        kept = [w for k, w in enumerate(own) if k not in gone]
        out[i] = (len(own), len(gone), b" ".join(kept).decode())
    return out


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def quality(text):
    """The base measures, and the largest share of characters in repeated runs of n words."""
    own = words(text)
    lines = [tuple(x.encode().split()) and x for x in (text or "").split("\n")]
    lines = [x for x in lines if x]
    size = [len(w.decode()) for w in own]
    total = sum(size)

    def covered(n, from_place):
        seen, inside = defaultdict(list), set()
        for s in range(len(own) - n + 1):
            seen[tuple(own[s:s + n])].append(s)
        for places in seen.values():
            if len(places) > 1:
                for s in places[from_place:]:
                    inside.update(range(s, s + n))
        return inside, seen
    grams = {n: sum(size[k] for k in covered(n, 1)[0]) / total if total else 0.0
             for n in range(5, 11)}
    tops = {}
    for n in (2, 3, 4):
        seen = covered(n, 0)[1]
        tops[n] = max([len(p) * sum(len(w.decode()) for w in run) / total
                       for run, p in seen.items() if len(p) > 1], default=0.0)
    return {"n_words": len(own), "word_chars": total,
            "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered(3, 0)[0]), "grams": grams, "tops": tops,
            "n_lines": len(lines)}


def levelled(totals, weights=(3, 1, 2), share=1.5, most=2):
    """Targets of the sources in order, by handing on the excess again and again."""
    weight = [weights[k % len(weights)] for k in range(len(totals))]
    target, full, rest = [0.0] * len(totals), set(), share * sum(totals)
    while rest > 1e-9 and len(full) < len(totals):
        whole = sum(w for k, w in enumerate(weight) if k not in full)
        for k in set(range(len(totals))) - full:
            target[k] += rest * weight[k] / whole
        rest = 0.0
        for k in set(range(len(totals))) - full:
            if target[k] >= most * totals[k]:
                rest += target[k] - most * totals[k]
                target[k] = most * totals[k]
                full.add(k)
    return target


def edits(a, b):
    """Distance with transpositions of neighbours."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], rows[-2][j - 2] + 1)
        rows.append(row)
    return rows[-1][-1]


def pieces(text, v):
    """Ids of a marked text by a search over all of it."""
    best = [(0.0, 0, None)]
    for end in range(1, len(text) + 1):
        c = (best[end - 1][0] + v.byte_score * len(text[end - 1].encode()), end - 1, -1)
        for start in range(end - 1, max(0, end - v.longest) - 1, -1):
            i = v.pieces.get(text[start:end])
            if i is not None and best[start][0] + v.score[i] >= c[0]:
                c = (best[start][0] + v.score[i], start, i)
        best.append(c)
    path, end = [], len(text)
    while end:
        path.append((best[end][1], end, best[end][2]))
        end = best[end][1]
    return [i for a, b, n in reversed(path) for i in (
        [int(v.byte[x]) for x in text[a:b].encode()] if n < 0 else [n])]


def _byte_pieces(tokenizer, ids):
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    return [bytes(byte[c] for c in tokenizer.id_to_token(i)) for i in ids]


def aligned(rows, byte_path, piece_path):
    """Every pair of tokens compared, text by text, with the libraries' own ids."""
    import sentencepiece
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(byte_path)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    docs, count = [], Counter()
    for i, text in rows:
        a, b = [], []
        if text:
            a_ids, b_ids = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            a_raw = _byte_pieces(tokenizer, a_ids)
            b_raw = [bytes([int(model.id_to_piece(x)[1:-1], 16)]) if model.is_byte(x)
                     else model.id_to_piece(x).replace("▁", " ").encode() for x in b_ids]
            if b"".join(a_raw) == (" " + text).encode() == b"".join(b_raw):
                for side, ids, raw in ((a, a_ids, a_raw), (b, b_ids, b_raw)):
                    end = 0
                    for x, own in zip(ids, raw):
                        end += len(own)
                        side.append((x, end))
        links = [(x, y) for x, e in a for y, f in b if e == f]
        groups, low = [], 0
        for high in sorted({e for _, e in a} & {e for _, e in b}):
            parts = [",".join(str(x) for x, e in side if low < e <= high) for side in (a, b)]
            groups.append("|".join(parts))
            low = high
        count.update(links)
        told = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        docs.append((i, len(a), len(b), len(groups), links, told))
    best = defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(i, n_a, n_b, n, len(links), sum(count[x] == best[x[1]] for x in links),
             sum(count[x] for x in links), told) for i, n_a, n_b, n, links, told in docs]


def hard_negatives(rows, scale=256.0, positives=5, negatives=3, least=50, most=95):
    """(id, label, vector, anchor) rows; every anchor against every row, in Python integers."""
    used = []
    for i, label, vector, anchor in rows:
        if None in (i, label, vector) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.append((i, label, [math.floor(scale * x) for x in vector], anchor))
    out = set()
    for i, label, own, anchor in used:
        if not anchor:
            continue
        scored = [(-sum(x * y for x, y in zip(own, v)), j, other) for j, other, v, _ in used]
        near = sorted({(s, j) for s, j, other in scored if other == label and j != i})[:positives]
        for p, j in near:
            fit = sorted({(s, k) for s, k, other in scored
                          if other != label and least * -p <= 100 * -s <= most * -p})
            out |= {(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(fit[:negatives], 1)}
    return out
