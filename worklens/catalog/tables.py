"""The domain tables of one data folder, loaded once per application.

A load writes lines, works, members and scores to the shared folder; the queries then
read those tables, as they would read a nightly load on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import detectors, ingest, ledger, postings, vendors
from ..plans import scoring, search
from ..session import cut, cut_by, shared_dir
from ..sources import fixtures

_LOADED: dict[tuple[str, str, str], DataFrame | postings.Index | int] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.p = spark, sf_dir, fixtures.FIXTURE

    def raw(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)

    def _kept(self, name: str, make):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _LOADED:
            _LOADED[key] = make()
        return _LOADED[key]

    def _once(self, name: str, build) -> DataFrame:
        return self._kept(name, lambda: cut(build(), name))

    @property
    def parts(self) -> int:
        """Lines, works and their scores lie by order in as many buckets: joined in place."""
        return self._kept("parts", lambda: fixtures.parts_for(self.spark, self.sf_dir))

    def _by_order(self, name: str, build, key: str = "order_id") -> DataFrame:
        return self._kept(name, lambda: cut_by(build(), name, key, self.parts))

    @property
    def lines(self) -> DataFrame:
        return self._by_order("lines", lambda: fixtures.lines(
            self.spark, self.sf_dir, self.parts), "l_orderkey")

    @property
    def works(self) -> DataFrame:
        # work_key is the identity of a loaded work: a key met twice is loaded once. The key
        # starts with the order's number, so that equal keys are of one order.
        return self._by_order("works", lambda: ingest.one_per_key(
            fixtures.works(self.spark, self.sf_dir, self.lines), "work_key", ("order_id",)))

    @property
    def payments(self) -> DataFrame:
        """The written lines, seen as payments: reading them costs less than writing them again."""
        return self._kept("payments", lambda: fixtures.payments(
            self.spark, self.sf_dir, self.lines))

    @property
    def members(self) -> DataFrame:
        return self._once("members", lambda: fixtures.members(self.spark, self.sf_dir))

    @property
    def similarity(self) -> DataFrame:
        return self._by_order("similarity", lambda: fixtures.similarity(self.works))

    @property
    def scores_by_order(self) -> DataFrame:
        return self._by_order("scores", lambda: scoring.score_works(
            self.works, self.payments, self.p, fixtures.similarity(self.works),
            use_forest=False, beside=("order_id",), parts=self.parts))

    @property
    def scores(self) -> DataFrame:
        return self.scores_by_order.select(*scoring.SCORE_COLUMNS)

    @property
    def scored(self) -> DataFrame:
        """Works with their scores: what every desk and queue reads."""
        return self._by_order("scored", lambda: scoring.scored_view(
            self.works, self.scores_by_order, self.parts))

    def _posted(self, name: str, build, fields: list[str], near: list[str]) -> postings.Index:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        return self._kept(name, lambda: postings.write_index(build(), path, fields, near))

    @property
    def work_index(self) -> postings.Index:
        """Scored works, searchable by any of their texts."""
        return self._posted("work-index", lambda: self.scored, search.WORK_TEXTS,
                            ["state", "district", "implementing_agency", "mp_name", "work_key"])

    @property
    def entity_index(self) -> postings.Index:
        return self._posted("entity-index", lambda: search.search_index(self.works), ["label"],
                            ["kind", "label", "sub", "entity_id"])

    @property
    def profile(self) -> DataFrame:
        return self._once("profile", lambda: vendors.vendor_profile(self.payments, self.p))

    @property
    def findings(self) -> DataFrame:
        return self._once("findings", lambda: detectors.run_detectors(
            self.works, self.payments, self.members, self.p))

    @property
    def review_events(self) -> DataFrame:
        return self._by_order("review_events", lambda: fixtures.review_events(
            self.spark, self.sf_dir, self.lines, self.parts))

    @property
    def verdicts(self) -> DataFrame:
        """By order like the works: the queues join them where they lie."""
        beside = ("order_id",)
        return self._by_order("verdicts", lambda: ledger.current_verdict(
            ledger.accepted(self.review_events, self.works, beside)[0], beside=beside))
