"""The engine: definitions, facts and stored memberships behind one API."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.values import RuleError, instant_literal
from ..operators import lifecycle, lookup, membership
from ..operators.conditions import ConditionRegistry
from ..operators.features import ORDER_FEATURES, feature_table
from ..operators.joins import lookup_join
from ..operators.partials import feature_table_of
from ..session import small_table, written
from ..sources.definition_store import DefinitionStore
from ..sources.export import write_members
from ..sources.fact_store import FactStore
from ..sources.membership_store import MembershipStore
from ..sources.shop import VOID_STATES, Shop
from .evaluate import RuleSet, active_rules, compile_segments, deadlines, deadlines_from, matches, matches_from
from .rule_index import listed_matches

# The actions recorded in the activity log.
REFRESH_BEFORE, REFRESH_FAILED, SAVED = "refresh_before", "refresh_failed", "saved"

log = logging.getLogger(__name__)


@dataclass
class RefreshReport:
    """Members per refreshed segment, and why other segments were not refreshed.

    The listed rules of a large catalogue are not in these but in ``listed`` (segment_id, customer_count; NULL: not
    refreshed, see the log).
    """

    counts: dict[int, int] = field(default_factory=dict)
    failures: dict[int, str] = field(default_factory=dict)
    listed: DataFrame | None = None

    @property
    def total(self) -> int:
        more = self.listed.selectExpr("coalesce(sum(customer_count), 0)").first()[0] if self.listed is not None else 0
        return sum(self.counts.values()) + more


class SegmentEngine:
    """``segments`` is a table of definitions, or the store that keeps them.

    ``streamed`` names the kinds of facts ("orders", "carts") of which everything new comes through ``place_orders`` and
    ``change_carts`` after ``build_facts``: of those, some customers are evaluated from kept facts.
    """

    def __init__(
        self,
        shop: Shop,
        segments: DataFrame | DefinitionStore,
        store: MembershipStore,
        registry: ConditionRegistry | None = None,
        streamed: Iterable[str] = (),
    ) -> None:
        self.shop = shop
        self.streamed = tuple(streamed)
        self.definitions = segments
        self.store = store
        self.registry = registry or ConditionRegistry()
        self.spark = store.spark

    @property
    def _defined(self) -> DataFrame:
        """The definitions as they were saved."""
        stored = isinstance(self.definitions, DefinitionStore)
        return self.definitions.segments() if stored else self.definitions

    @property
    def segments(self) -> DataFrame:
        """The definitions with the count and time of their latest refresh."""
        newest = {"customer_count", "last_refreshed"}
        columns = [
            f"coalesce(s.{name}, d.{name}) AS {name}" if name in newest else f"d.{name}" for name in self._defined.columns
        ]
        known = self._defined.alias("d").join(self.store.status().alias("s"), F.expr("s.segment_id = d.segment_id"), "left")
        return known.selectExpr(*columns)

    def list_segments(
        self,
        chosen: lifecycle.SegmentFilter | None = None,
        sort_by: str = "segment_id",
        page: int = 1,
        size: int = 20,
        descending: bool = False,
    ) -> lifecycle.Page:
        """One page of the definitions, with labels, and how many there are."""
        return lifecycle.list_segments(self.segments, chosen or lifecycle.SegmentFilter(), sort_by, page, size, descending)

    def stale(self, now: dt.datetime) -> DataFrame:
        """Active scheduled segments, and realtime ones whose last refresh is too long ago."""
        return lifecycle.segments_stale(self.segments, now)

    def needs_refresh(self, now: dt.datetime) -> DataFrame:
        return lifecycle.needs_refresh(self.segments, now)

    def save_segments(self, changes: DataFrame, now: dt.datetime) -> DataFrame:
        """Create or update stored definitions; the saved rows."""
        saved = self.definitions.save(changes, now)
        self.store.append_log(log_rows(saved, SAVED, now))
        return saved

    def delete_segments(self, ids: DataFrame) -> list[int]:
        """Delete stored definitions with their members; the ids that existed."""
        gone = sorted(row.segment_id for row in self.definitions.delete(ids).collect())
        if gone:
            self.store.drop(gone)
        return gone

    def activity_log(self) -> DataFrame:
        """The log of the segments that still exist."""
        return self.store.log().join(self._defined.select("segment_id"), "segment_id", "left_semi")

    # -- refresh ---------------------------------------------------------------

    def refresh_segment(self, segment_id: int, now: dt.datetime) -> int:
        """Replace the members of one segment; an inactive one is left alone (0)."""
        definition = self._defined.where(F.col("segment_id") == segment_id)
        row = definition.select("is_active").first()
        if row is None:
            raise LookupError(f"no segment {segment_id}")
        if not row.is_active:
            return 0
        report = self._refresh(compile_segments(definition, self.registry), now)
        if segment_id in report.failures:
            raise RuleError(report.failures[segment_id])
        return report.counts[segment_id]

    def refresh_all(self, now: dt.datetime) -> RefreshReport:
        return self._refresh(active_rules(self._defined, self.registry, listed=True), now)

    def mass_refresh(self, segment_ids: Iterable[int], now: dt.datetime) -> RefreshReport:
        """Refresh a list of segments in one pass; unknown ids are reported as failed."""
        wanted = sorted(set(segment_ids))
        chosen = self._defined.where(F.col("segment_id").isin(wanted))
        state = {row.segment_id: row.is_active for row in chosen.select("segment_id", "is_active").collect()}
        report = self._refresh(active_rules(chosen, self.registry), now)
        for segment_id in wanted:
            if segment_id not in state:
                report.failures[segment_id] = "no such segment"
            elif not state[segment_id]:
                report.counts[segment_id] = 0
        return report

    def refresh_due(self, ticks: DataFrame, now: dt.datetime) -> RefreshReport:
        """A scheduled run."""
        due = lifecycle.segments_due(self._defined, ticks, now)
        return self._refresh(compile_segments(due, self.registry, listed=True), now)

    def refresh_definitions(self, definitions: DataFrame, now: dt.datetime, batch: str | None = None) -> RefreshReport:
        """Refresh the active ones among some definitions, once per batch name."""
        if batch is not None and self.store.applied(batch):
            return RefreshReport()
        return self._refresh(active_rules(definitions, self.registry, listed=True), now, batch)

    def _refresh(self, rules: RuleSet, now: dt.datetime, batch: str | None = None) -> RefreshReport:
        report = RefreshReport(failures=dict(rules.failures))
        self._log([(segment_id, REFRESH_BEFORE, None, now) for segment_id in sorted({*rules.rules, *rules.failures})])
        if rules.listed is not None:
            report.listed = self._refresh_listed(rules.listed, now)
        groups = [rules.rules] if rules.rules else []
        marked = batch is None
        while groups:
            group = groups.pop()
            last = batch if not groups else None  # a batch counts as done with the commit of its last part
            try:
                found = matches(self.shop, RuleSet(group), now, self.registry)
                flips = deadlines(self.shop, RuleSet(group), now, self.registry)
                report.counts |= self.store.replace(found, group, now, last, flips)
                marked = marked or last is not None
            except (PySparkException, Py4JError) as problem:
                if len(group) > 1:  # the facts of some rule cannot be read: look for it in either half
                    ordered = sorted(group.items())
                    groups += [dict(ordered[: len(ordered) // 2]), dict(ordered[len(ordered) // 2 :])]
                else:
                    report.failures |= dict.fromkeys(group, str(problem))
        if not marked:
            self.store.mark(batch)
        for segment_id, problem in report.failures.items():
            log.error("segment %s not refreshed: %s", segment_id, problem)
        self._log_refresh(report, now)
        return report

    def _refresh_listed(self, listed: DataFrame, now: dt.datetime) -> DataFrame:
        """Replace the members of listed rules; segment_id, customer_count of each.

        If the facts of some cannot be read, the rules are refreshed by the kinds of facts they ask for.
        """
        ids = listed.select("segment_id").distinct()
        self._log_all(ids, REFRESH_BEFORE, None, now)
        try:
            return self.store.replace_listed(listed_matches(self.shop, listed), ids, now)
        except (PySparkException, Py4JError):
            kinds = written(listed.groupBy("segment_id").agg(F.sort_array(F.collect_set("source")).alias("kinds")), "rule-kinds")
        done = []
        for row in sorted(kinds.select("kinds").distinct().collect()):
            ids = kinds.where(F.col("kinds") == F.array(*map(F.lit, row.kinds))).select("segment_id")
            chosen = listed.join(ids, "segment_id", "left_semi")
            try:
                done.append(self.store.replace_listed(listed_matches(self.shop, chosen), ids, now))
            except (PySparkException, Py4JError) as problem:
                log.error("segments that ask for %s not refreshed: %s", ", ".join(row.kinds), problem)
                self._log_all(ids, REFRESH_FAILED, str(problem), now)
                done.append(ids.selectExpr("segment_id", "CAST(NULL AS BIGINT) AS customer_count"))
        return reduce(DataFrame.unionByName, done)

    def _log_all(self, ids: DataFrame, action: str, details: str | None, now: dt.datetime) -> None:
        rows = ids.select("segment_id", F.lit(action).alias("action"), F.lit(details).cast("string").alias("details"))
        self.store.append_log(rows.selectExpr("*", f"{instant_literal(now)} AS created_at"))

    def _log_refresh(self, report: RefreshReport, now: dt.datetime) -> None:
        # what was refreshed is logged by its commit
        self._log([(sid, REFRESH_FAILED, problem, now) for sid, problem in report.failures.items()])

    def _log(self, rows: list[tuple]) -> None:
        if rows:
            self.store.append_log(small_table(self.spark, rows, schemas.SEGMENT_LOG))

    def refreshed_segments(self) -> DataFrame:
        """The same as ``segments``."""
        return self.segments

    # -- incremental refresh ---------------------------------------------------

    def refresh_elapsed(self, now: dt.datetime, batch: str | None = None) -> int | None:
        """A run without events: re-evaluate the customers for whom time alone may have changed an answer."""
        nobody = small_table(self.spark, [], "customer_id bigint")
        return self.refresh_customers(nobody, now, batch=batch, elapsed=True)

    def refresh_customers(
        self,
        touched: DataFrame,
        now: dt.datetime,
        add_only: bool = False,
        batch: str | None = None,
        elapsed: bool = False,
    ) -> int | None:
        """Re-evaluate the realtime segments for some customers only.

        ``touched`` is a (micro-)batch with ``customer_id``; duplicates and NULLs are
        ignored. Members that stay keep their ``assigned_at``. With ``elapsed``, customers for whom time alone may have
        changed an answer since the last such run are evaluated too. The next deadline of everyone evaluated is stored
        with the outcome.
        """
        if batch is not None and self.store.applied(batch):
            return None
        rules = active_rules(self._defined, self.registry, "realtime")
        for segment_id, problem in rules.failures.items():
            log.error("segment %s not evaluated: %s", segment_id, problem)
        if not rules.rules:
            return None
        people = touched.select("customer_id")
        if elapsed:
            people = people.unionByName(self.store.due(now).select("customer_id"))
        shop, touched, rows = self._shop_of(people.where("customer_id > 0"))
        facts = self._facts(rules)
        if facts is not None:
            found, flips = self._from_kept(shop, facts.rows(touched, rows), facts, rules, now)
        elif rules.flips:
            features = feature_table(shop, rules.features | rules.moments, now, self.registry.facts)
            found, flips = self._decided(features, rules, now)
        else:
            found, flips = matches(shop, rules, now, self.registry), None
        delta = membership.delta(found, self._held(rules, touched, rows), add_only)
        return self.store.change(delta, now, batch, flips, now if elapsed else None)

    def _held(self, rules: RuleSet, touched: DataFrame, rows: int) -> DataFrame:
        held = self.store.members().where(F.col("segment_id").isin(list(rules.rules)))
        return lookup_join(held, touched, "customer_id", rows, "left_semi")

    # -- new facts -------------------------------------------------------------

    def build_facts(self, shop: Shop | None = None) -> None:
        """Keep the streamed kinds of facts, as they are in ``shop``: all that came before the streams begin."""
        facts = self._fact_store(active_rules(self._defined, self.registry, "realtime"))
        facts.build(shop or self.shop)

    def _fact_store(self, rules: RuleSet) -> FactStore:
        return FactStore(self.store, self.shop, rules.features | rules.moments, self.streamed)

    def _facts(self, rules: RuleSet) -> FactStore | None:
        """The kept facts, where they were built for these rules."""
        facts = self._fact_store(rules) if self.streamed else None
        return facts if facts is not None and facts.is_built() else None

    def _from_kept(
        self, shop: Shop, parts: DataFrame, facts: FactStore, rules: RuleSet, now: dt.datetime
    ) -> tuple[DataFrame, DataFrame]:
        """Matches, and deadlines, of the customers of ``shop``."""
        wanted = rules.features | rules.moments
        return self._decided(feature_table_of(shop, parts, facts.wanted, wanted, now, self.registry.facts), rules, now)

    def _decided(self, features: DataFrame, rules: RuleSet, now: dt.datetime) -> tuple[DataFrame, DataFrame | None]:
        """Matches and deadlines; the features, of some customers only, are read twice."""
        features = written(features, "features") if rules.flips else features
        return matches_from(features, rules.rules), deadlines_from(features, rules, now) if rules.flips else None

    def place_orders(self, orders: DataFrame, now: dt.datetime, batch: str | None = None, elapsed: bool = True) -> int | None:
        """New orders (rows of ``sales_order``) of a micro-batch: their customers' realtime segments follow.

        Guest orders are ignored. An order that does not count (any more), or a row with a true ``changed``, makes its
        customer's facts be computed again from the shop. Kept facts and members change with one commit.
        """
        return self._add_facts("sales_order", "order_id", orders, "state IS NULL OR state IN {void}", now, batch, elapsed)

    def change_carts(self, carts: DataFrame, now: dt.datetime, batch: str | None = None, elapsed: bool = True) -> int | None:
        """New and updated carts (rows of ``quote``) of a micro-batch, likewise; one that is not active is computed again."""
        return self._add_facts("quote", "quote_id", carts, "is_active IS DISTINCT FROM 1", now, batch, elapsed)

    def _add_facts(
        self, table: str, key: str, rows: DataFrame, gone: str, now: dt.datetime, batch: str | None, elapsed: bool
    ) -> int | None:
        if batch is not None and self.store.applied(batch):
            return None
        rules = active_rules(self._defined, self.registry, "realtime")
        facts = self._facts(rules)
        if facts is None or not rules.rules:
            return self.refresh_customers(rows, now, batch=batch, elapsed=elapsed)
        rows = written(rows.where("customer_id > 0").dropDuplicates([key]), "new-facts")
        gone = gone.format(void=VOID_STATES) + (" OR coalesce(changed, false)" if "changed" in rows.columns else "")
        people = rows.select("customer_id")
        if elapsed:
            people = people.unionByName(self.store.due(now).select("customer_id"))
        shop, touched, count = self._shop_of(people.where("customer_id > 0"))
        renewed = written(rows.where(gone).select("customer_id").distinct(), "renewed")
        again = renewed.count()
        with self.store.lock:
            if facts.fold():
                log.info("kept facts folded")
            seq = self.store.next_seq()
            more = facts.add(seq, shop.only(table, rows), renewed if again else None, self.shop.for_customers(renewed, again))
            found, flips = self._from_kept(shop, facts.rows(touched, count, pending=seq), facts, rules, now)
            delta = membership.delta(found, self._held(rules, touched, count))
            return self.store.change(delta, now, batch, flips, now if elapsed else None, seq, more)

    def _shop_of(self, people: DataFrame) -> tuple[Shop, DataFrame, int]:
        """The facts of some customers only, their distinct ids, and how many they are."""
        touched = written(people.select("customer_id").distinct(), "touched")
        rows = touched.count()
        return self.shop.for_customers(touched, rows), touched, rows

    def assign(self, pairs: DataFrame, now: dt.datetime, batch: str | None = None) -> int:
        """Assign (customer_id, segment_id) pairs by hand, an upsert; how many there were."""
        rows = pairs.select(*membership.KEYS).distinct()
        return self._change_by_hand(rows.withColumn("assigned", F.lit(True)), now, batch)

    def unassign(self, pairs: DataFrame, now: dt.datetime, batch: str | None = None) -> int:
        """Remove pairs by hand; how many of them were members."""
        rows = self.members().join(pairs, membership.KEYS, "left_semi").select(*membership.KEYS)
        return self._change_by_hand(rows.withColumn("assigned", F.lit(False)), now, batch)

    def forget_customers(self, people: DataFrame, now: dt.datetime, batch: str | None = None) -> int:
        """Remove deleted customers (``customer_id``) from every segment; how many memberships that were."""
        gone = people.select("customer_id").where("customer_id IS NOT NULL").distinct()
        rows = self.members().join(gone, "customer_id", "left_semi").select(*membership.KEYS)
        return self._change_by_hand(rows.withColumn("assigned", F.lit(False)), now, batch)

    def _change_by_hand(self, delta: DataFrame, now: dt.datetime, batch: str | None) -> int:
        seq = self.store.change(delta, now, batch)
        return 0 if seq is None else self.store.changes(seq).count()

    # -- evaluation without writing --------------------------------------------

    def matches(self, now: dt.datetime, *segment_ids: int) -> DataFrame:
        """(segment_id, customer_id) of the active segments, all or some."""
        chosen = self._defined.where(F.col("segment_id").isin(*segment_ids)) if segment_ids else self._defined
        return matches(self.shop, active_rules(chosen, self.registry, listed=True), now, self.registry)

    def match_check(self, pairs: DataFrame, now: dt.datetime) -> DataFrame:
        """For distinct (customer_id, segment_id) pairs: does the rule match?

        Inactive, unknown and uncompilable segments match nobody. Only the customers
        and segments asked for are evaluated.
        """
        asked = pairs.select(*membership.KEYS).distinct()
        wanted = self._defined.join(asked.select("segment_id").distinct(), "segment_id", "left_semi")
        shop, _, _ = self._shop_of(asked)
        found = matches(shop, active_rules(wanted, self.registry, listed=True), now, self.registry)
        return lookup.membership_check(asked, found).withColumnRenamed("in_segment", "matches")

    def validate_batch(
        self, candidates: DataFrame, attribute: str, op: str, value: object, entity: str, now: dt.datetime
    ) -> DataFrame:
        """Candidate customers for whom one comparison holds.

        Entity ``customer`` tests an attribute; ``order`` an order aggregate, where
        customers without orders form no group and so never match. Anything else: none.
        """
        known = {"customer": self.registry.attributes("Customer"), "order": list(ORDER_FEATURES)}
        if attribute not in known.get(entity, []):
            return candidates.select("customer_id").where("false")
        leaf = self.registry.leaf(entity.capitalize(), attribute, op, value)
        features, test = set(leaf.features), leaf.predicate
        if entity == "order":
            features.add(ORDER_FEATURES["total_orders"])
            test = f"total_orders > 0 AND {test}"
        shop, _, _ = self._shop_of(candidates)
        return feature_table(shop, features, now).where(test).select("customer_id")

    # -- look-ups --------------------------------------------------------------

    def members(self) -> DataFrame:
        return self.store.members()

    def customer_segments(self, people: DataFrame | None = None) -> DataFrame:
        """customer_id, segment_id, name, description of every membership, or of those of some customers."""
        members = self.members()
        if people is not None:
            members = members.join(people.select("customer_id").distinct(), "customer_id", "left_semi")
        return lookup.customer_segments(members, self._defined)

    def customers(self, segment_id: int, page: int = 1, size: int = 20) -> lifecycle.Page:
        """One page of a segment's members."""
        return lookup.matched_customers(self.shop, self.members(), segment_id, page, size)

    def export(self, segment_id: int, path: str, kind: str, safe_csv: bool = False) -> None:
        """Write a segment's members to ``path``; an unknown segment is an error."""
        if self._defined.where(F.col("segment_id") == segment_id).isEmpty():
            raise LookupError(f"no segment {segment_id}")
        write_members(lookup.export_members(self.shop, self.members(), segment_id), path, kind, safe_csv)


def log_rows(segments: DataFrame, action: str, now: dt.datetime) -> DataFrame:
    """Activity-log rows for saved definitions."""
    return segments.selectExpr(
        "segment_id", f"'{action}' AS action", "name AS details", f"{instant_literal(now)} AS created_at"
    )
