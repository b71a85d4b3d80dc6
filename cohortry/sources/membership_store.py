"""The stored membership relation (segment_id, customer_id, assigned_at).

Three append-only Parquet tables below one root::

    members/seq=N/segment_group=G/  full member lists written by refreshes, sorted by segment and customer
    changes/seq=N/                  single assignments and removals
    deadlines/seq=N/due_week=D/     when time alone may next change a customer's answers
    commits/seq=N/                  what became visible with write N
    folded/upto=N/                  the same for all writes up to N, in place of their folders
    log/                            what was done beside refreshes and changes, which are their own log

Data is written first and becomes visible with the one-file commit behind it. A failed
or lost job therefore leaves the previous state in place, a segment that matches nobody
any more is simply committed with count 0, and no plan ever overwrites what it reads.
Streams and refreshes of one application may write at the same time; between
applications one writer at a time is assumed.
"""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.values import all_of, any_of, instant_literal
from ..operators.joins import lookup_join
from ..session import small_table, written

_COMMITS = "kind string, batch string, segment_id int, customer_count bigint, committed_at timestamp_ntz"
_CHANGES = "segment_id int, customer_id bigint, assigned boolean, assigned_at timestamp_ntz"
_DEADLINES = "customer_id bigint, due_at timestamp_ntz"
MOST_STATES = 5_000  # commit rows from which current lists are told by a join and not on the driver
MOST_NAMED = 500  # lists that a filter names one by one
GROUPS = 64  # folders of the lists of one write: a few segments have one each, thousands share them
REFRESH, FOLD, CHANGE, DEADLINES, CLOCK, BATCH = "refresh", "fold", "change", "deadlines", "clock", "batch"
MOST_COMMITS = 100  # commit files after which they are folded into one
MOST_CHANGES = 50  # open changes after which the lists they belong to are written anew
# The actions recorded in the activity log.
REFRESH_AFTER, ASSIGNED, REMOVED = "refresh_after", "assigned", "removed"


class _Writing:
    """What the writers of one application on one root share."""

    def __init__(self) -> None:
        self.lock = threading.RLock()
        self.last = 0


_WRITING: dict[str, _Writing] = {}


class MembershipStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root
        self._writing = _WRITING.setdefault(root, _Writing())
        # mode("ignore") keeps an existing store and gives a new one its empty tables
        small_table(spark, [], _COMMITS).write.mode("ignore").parquet(f"{root}/commits/seq=0")
        small_table(spark, [], schemas.SEGMENT_LOG).write.mode("ignore").parquet(f"{root}/log/seq=0")

    # -- reading ---------------------------------------------------------------

    def commits(self) -> DataFrame:
        upto = self._folded()
        later = self.spark.read.schema(f"{_COMMITS}, seq int").parquet(f"{self.root}/commits")
        if upto is None:
            return later
        earlier = self.spark.read.schema(f"{_COMMITS}, seq int").parquet(f"{self.root}/folded/upto={upto}")
        return earlier.unionByName(later.where(f"seq > {upto}"))

    def _folders(self, name: str) -> dict[int, object]:
        """Numbers of the folders ``name``/...=N, with their paths."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [status.getPath() for status in files.listStatus(path)] if files.exists(path) else []
        numbered = [(p.getName().rsplit("=", 1), p) for p in found if "=" in p.getName()]
        # a write that failed left no such mark
        done = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return {int(number): p for (_, number), p in numbered if name != "folded" or done(p)}

    def _folded(self) -> int | None:
        return max(self._folders("folded"), default=None)

    def fold_commits(self) -> None:
        """Write all commit rows into one file and remove the files they came from.

        Whoever reads meanwhile sees either; a crash in between leaves files that are not read any more.
        """
        with self._writing.lock:
            rows = self.commits()
            upto = rows.selectExpr("max(seq)").first()[0]
            rows.repartition(1).write.mode("overwrite").parquet(f"{self.root}/folded/upto={upto}")
            conf = self.spark._jsc.hadoopConfiguration()
            # the empty first commit stays, so that the folder is there
            for name, first in (("commits", 1), ("folded", 0)):
                for number, path in self._folders(name).items():
                    if first <= number <= upto and not (name == "folded" and number == upto):
                        path.getFileSystem(conf).delete(path, True)

    def status(self) -> DataFrame:
        """Latest refresh per segment: segment_id, customer_count, last_refreshed."""
        return (
            self.commits()
            .where(f"kind IN ('{REFRESH}', '{FOLD}')")
            .groupBy("segment_id")
            .agg(F.expr("max_by(customer_count, seq) AS customer_count"), F.expr("max_by(committed_at, seq) AS last_refreshed"))
        )

    def history(self) -> DataFrame:
        """Segment size after each refresh, and the growth since the one before."""
        refreshes = self.commits().where(f"kind = '{REFRESH}' AND committed_at IS NOT NULL")
        before = "lag(customer_count) OVER (PARTITION BY segment_id ORDER BY seq)"
        return refreshes.selectExpr(
            "segment_id", "committed_at AS refreshed_at", "customer_count", f"customer_count - {before} AS growth"
        )

    def log(self) -> DataFrame:
        """The activity log: what was appended, and every committed refresh and change.

        Those rows are read from the commits and the changes themselves, so none is lost or written twice, whatever
        fails in between.
        """
        columns = _columns(schemas.SEGMENT_LOG)
        appended = self.spark.read.schema(f"{schemas.SEGMENT_LOG}, seq int").parquet(f"{self.root}/log").select(*columns)
        commits = self.commits()
        refreshed = commits.where(f"kind = '{REFRESH}' AND committed_at IS NOT NULL").selectExpr(
            "segment_id", f"'{REFRESH_AFTER}' AS action", "concat('assigned_count=', CAST(customer_count AS STRING)) AS details",
            "committed_at AS created_at",
        )
        found = appended.unionByName(refreshed)
        seqs = sorted(row.seq for row in commits.where(f"kind = '{CHANGE}'").select("seq").distinct().collect())
        if not seqs:
            return found
        return found.unionByName(
            self.spark.read.schema(_CHANGES).parquet(*[f"{self.root}/changes/seq={seq}" for seq in seqs]).selectExpr(
                "segment_id", f"if(assigned, '{ASSIGNED}', '{REMOVED}') AS action",
                "concat('customer_id=', CAST(customer_id AS STRING)) AS details", "assigned_at AS created_at",
            )
        )

    def _visible(self) -> tuple[dict[int, tuple[int, int]], dict[int, list[int]]]:
        """Per segment its refresh (seq, count); per later change the segments it touches.

        Both are bounded by the number of segments and of changes not yet folded in;
        member rows never come to the driver.
        """
        latest: dict[int, tuple[int, int]] = {}
        changes: dict[int, list[int]] = {}
        newest = self.commits().groupBy("kind", "segment_id", F.expr(f"if(kind = '{CHANGE}', seq, NULL) AS change"))
        rows = newest.agg(F.expr("max(seq) AS seq"), F.expr("max_by(customer_count, seq) AS members")).collect()
        for row in rows:
            if row.kind in (REFRESH, FOLD) and row.seq > latest.get(row.segment_id, (0, 0))[0]:
                latest[row.segment_id] = (row.seq, row.members)
        for row in rows:
            if row.kind == CHANGE and row.segment_id is not None and row.seq > latest.get(row.segment_id, (0, 0))[0]:
                changes.setdefault(row.seq, []).append(row.segment_id)
        return latest, changes

    def members(self) -> DataFrame:
        """The current relation: refreshed lists with later changes applied.

        Only the segments that have open changes are merged; the lists of the others are
        read as they are.
        """
        if self.commits().limit(MOST_STATES + 1).count() > MOST_STATES:
            return self._members_of_many()
        latest, changes = self._visible()
        touched = {segment_id for segment_ids in changes.values() for segment_id in segment_ids}
        columns = _columns(schemas.MEMBERSHIP)
        plain = self._lists({i: state for i, state in latest.items() if i not in touched}).select(*columns)
        if not touched:
            return plain
        paths = [f"{self.root}/changes/seq={seq}" for seq in sorted(changes)]
        reader = self.spark.read.schema(f"{_CHANGES}, seq int").option("basePath", f"{self.root}/changes")
        later = reader.parquet(*paths).where(_of_segments(changes))
        before = self._lists({i: state for i, state in latest.items() if i in touched}).withColumn("assigned", F.lit(True))
        return plain.unionByName(_merged(before.unionByName(later)).select(*columns))

    def _members_of_many(self) -> DataFrame:
        """The same for any number of segments; only the numbers of the writes come to the driver."""
        columns, commits = _columns(schemas.MEMBERSHIP), self.commits()
        refreshed = commits.where(f"kind IN ('{REFRESH}', '{FOLD}')").groupBy("segment_id")
        latest = refreshed.agg(F.expr("max(seq) AS list_seq"), F.expr("max_by(customer_count, seq) AS members"))
        changed = commits.where(f"kind = '{CHANGE}' AND segment_id IS NOT NULL").select("seq", "segment_id").distinct()
        changed = changed.join(latest.select("segment_id", "list_seq"), "segment_id", "left").where("seq > coalesce(list_seq, 0)")
        # one table of both, written once: a segment's current list, and the changes on top of it
        touched = changed.select("segment_id").distinct().withColumn("touched", F.lit(True))
        state = latest.join(touched, "segment_id", "left").selectExpr("segment_id", "list_seq", "members", "coalesce(touched, false) AS touched")
        state = written(state, "current-lists")
        current = state.where("members > 0")
        lists = small_table(self.spark, [], f"{schemas.MEMBERSHIP}, seq int, touched boolean")
        if seqs := sorted(row.list_seq for row in current.select("list_seq").distinct().collect()):
            reader = self.spark.read.schema(f"{schemas.MEMBERSHIP}, seq int, segment_group int").option("basePath", f"{self.root}/members")
            lists = reader.parquet(*[f"{self.root}/members/seq={seq}" for seq in seqs]).drop("segment_group")
            kept = current.select("segment_id", "list_seq", "touched")
            lists = lookup_join(lists, kept, "segment_id", current.count()).where("seq = list_seq").drop("list_seq")
        changed = written(changed.select("seq", "segment_id"), "open-changes")
        seqs = sorted(row.seq for row in changed.select("seq").distinct().collect())
        if not seqs:
            return lists.select(*columns)
        reader = self.spark.read.schema(f"{_CHANGES}, seq int").option("basePath", f"{self.root}/changes")
        later = reader.parquet(*[f"{self.root}/changes/seq={seq}" for seq in seqs]).join(changed, ["seq", "segment_id"], "left_semi")
        before = lists.where("touched").drop("touched").withColumn("assigned", F.lit(True))
        return lists.where("NOT touched").select(*columns).unionByName(_merged(before.unionByName(later)).select(*columns))

    def _lists(self, latest: dict[int, tuple[int, int]]) -> DataFrame:
        by_seq: dict[int, list[int]] = {}
        for segment_id, (seq, count) in latest.items():
            if count:
                by_seq.setdefault(seq, []).append(segment_id)
        if not by_seq:
            return small_table(self.spark, [], f"{schemas.MEMBERSHIP}, seq int")
        # only the folders of current refreshes are listed; within, groups prune folders and ids row groups
        schema = f"{schemas.MEMBERSHIP}, seq int, segment_group int"
        reader = self.spark.read.schema(schema).option("basePath", f"{self.root}/members")
        lists = reader.parquet(*[f"{self.root}/members/seq={seq}" for seq in sorted(by_seq)])
        wanted = sum(map(len, by_seq.values()))
        if wanted > MOST_NAMED:
            # a row per current list; lists that no refresh has replaced are read whole either way
            pairs = [(seq, segment_id) for seq, ids in by_seq.items() for segment_id in ids]
            current = small_table(self.spark, pairs, "seq int, segment_id int")
            return lookup_join(lists, current, ["seq", "segment_id"], wanted, "left_semi").drop("segment_group")
        groups = sorted({segment_id % GROUPS for ids in by_seq.values() for segment_id in ids})
        named = f"segment_group IN ({', '.join(map(str, groups))})"
        return lists.where(named).where(_of_segments(by_seq)).drop("segment_group")

    def _open_deadlines(self) -> dict[int, dt.datetime | None]:
        """Per committed write of deadlines up to when they have been dealt with by a later run.

        One entry per write since the deadlines were last folded.
        """
        wanted = self.commits().where(F.col("kind").isin(DEADLINES, CLOCK))
        rows = wanted.select("kind", "seq", "committed_at").distinct().collect()
        clocks = [(row.seq, row.committed_at) for row in rows if row.kind == CLOCK]
        since_fold = max((row.seq for row in rows if row.kind == DEADLINES and row.committed_at is not None), default=0)
        writes = sorted(row.seq for row in rows if row.kind == DEADLINES and row.seq >= since_fold)
        return {seq: max((at for later, at in clocks if later > seq), default=None) for seq in writes}

    def due(self, now: dt.datetime | None) -> DataFrame:
        """(customer_id, due_at) of the deadlines up to ``now`` that no run has dealt with; None: of all of them.

        Only folders of the weeks that matter are read. A customer who was evaluated since may be there once more than
        necessary, which changes nothing.
        """
        by_time: dict[dt.datetime | None, list[int]] = {}
        for seq, since in self._open_deadlines().items():
            by_time.setdefault(since, []).append(seq)
        if not by_time:
            return small_table(self.spark, [], _DEADLINES)
        parts = []
        for since, seqs in by_time.items():
            tests = [f"seq IN ({', '.join(map(str, seqs))})"]
            if now is not None:
                tests.append(f"due_week <= DATE '{now.date()}' AND due_at <= {instant_literal(now)}")
            if since is not None:
                week = since.date() - dt.timedelta(days=since.weekday())
                tests.append(f"due_week >= DATE '{week}' AND due_at > {instant_literal(since)}")
            parts.append(all_of(tests))
        paths = [f"{self.root}/deadlines/seq={seq}" for seqs in by_time.values() for seq in seqs]
        reader = self.spark.read.schema(f"{_DEADLINES}, seq int, due_week date").option("basePath", f"{self.root}/deadlines")
        return reader.parquet(*paths).where(any_of(parts)).select("customer_id", "due_at")

    # -- writing ---------------------------------------------------------------

    @property
    def lock(self) -> threading.RLock:
        """Held by whoever reads something in order to write what follows from it."""
        return self._writing.lock

    def _write_deadlines(self, seq: int, deadlines: DataFrame | None, clock: dt.datetime | None) -> list[tuple]:
        """Deadlines, to become visible with write ``seq``; the commit rows that make them so.

        ``clock``: deadlines up to then were dealt with by the same write.
        """
        rows = []
        if deadlines is not None:
            week = F.date_trunc("week", F.col("due_at")).cast("date").alias("due_week")
            weeks = deadlines.select("customer_id", "due_at", week).hint("rebalance", "due_week")
            ordered = weeks.sortWithinPartitions("due_week", "due_at")
            ordered.write.mode("overwrite").partitionBy("due_week").parquet(f"{self.root}/deadlines/seq={seq}")
            rows.append((DEADLINES, None, None, None, None))
        if clock is not None:
            rows.append((CLOCK, None, None, None, clock))
        return rows

    def fold_deadlines(self, now: dt.datetime) -> None:
        """Write the deadlines that are still open once more, each customer's next one only, so that reads open one folder."""
        with self._writing.lock:
            seq = self.next_seq()
            next_one = self.due(None).groupBy("customer_id").agg(F.min("due_at").alias("due_at"))
            self._write_deadlines(seq, next_one, None)
            self.commit(seq, [(DEADLINES, None, None, None, now)])

    def next_seq(self) -> int:
        """A number above all committed ones and those handed out to writes under way.

        A change that commits while a refresh is still running has the higher number, so
        it stays on top of the refreshed list.
        """
        with self._writing.lock:
            committed = self.commits().selectExpr("coalesce(max(seq), 0)").first()[0]
            self._writing.last = max(committed, self._writing.last) + 1
            return self._writing.last

    def applied(self, batch: str) -> bool:
        return not self.commits().where(F.col("batch") == batch).isEmpty()

    def mark(self, batch: str) -> None:
        """Say that a batch has been dealt with, where no other commit says so."""
        self.commit(self.next_seq(), [(BATCH, batch, None, None, None)])

    def _fold_if_many(self) -> None:
        if len(self._folders("commits")) > MOST_COMMITS:
            self.fold_commits()

    def commit(self, seq: int, rows: list[tuple] | DataFrame) -> None:
        # of a table every row goes through one task, as the one file is what makes them visible at once
        one_file = rows.repartition(1) if isinstance(rows, DataFrame) else small_table(self.spark, rows, _COMMITS).coalesce(1)
        one_file.write.mode("overwrite").parquet(f"{self.root}/commits/seq={seq}")

    def replace(
        self,
        matches: DataFrame,
        segment_ids: Iterable[int],
        now: dt.datetime,
        batch: str | None = None,
        deadlines: DataFrame | None = None,
    ) -> dict[int, int]:
        """Replace the members of some segments; returns members per segment.

        ``deadlines`` (customer_id, due_at) become visible with them.
        """
        lists = matches.selectExpr("segment_id", "customer_id", f"{instant_literal(now)} AS assigned_at")
        times = {int(segment_id): now for segment_id in segment_ids}
        seq = self.next_seq()
        return self._write_lists(seq, lists, times, batch, self._write_deadlines(seq, deadlines, None))

    def fold_changes(self) -> dict[int, int]:
        """Write full member lists of the segments with open changes, so reads merge nothing.

        Who is a member since when, and the time of the last refresh, stay as they are.
        """
        seq = self.next_seq()  # taken before reading: changes written meanwhile rank above
        changed = {segment_id for segment_ids in self._visible()[1].values() for segment_id in segment_ids}
        if not changed:
            return {}
        refreshed = {row.segment_id: row.last_refreshed for row in self.status().collect()}
        lists = self.members().where(F.col("segment_id").isin(sorted(changed)))
        return self._write_lists(seq, lists, {segment_id: refreshed.get(segment_id) for segment_id in changed}, None, kind=FOLD)

    def drop(self, segment_ids: Iterable[int]) -> None:
        """Forget the members of deleted segments."""
        self.commit(self.next_seq(), [(REFRESH, None, segment_id, 0, None) for segment_id in segment_ids])

    def _write_lists(
        self,
        seq: int,
        lists: DataFrame,
        refreshed: dict[int, dt.datetime | None],
        batch: str | None,
        more: Iterable[tuple] = (),
        kind: str = REFRESH,
    ) -> dict[int, int]:
        """Write and commit full member lists, ``refreshed`` at these times.

        Rows are rebalanced by group of segments before the write: AQE cuts the hot ones into
        several files and puts the small ones together, so neither one task nor a
        million tiny files result.
        """
        members = self._write_members(seq, lists)
        counts = dict.fromkeys(refreshed, 0)
        for row in members.groupBy("segment_id").count().collect():  # one row per segment
            counts[row.segment_id] = row["count"]
        commits = [(kind, batch, segment_id, count, refreshed[segment_id]) for segment_id, count in counts.items()]
        self.commit(seq, [*commits, *more])
        return counts

    def replace_listed(self, matches: DataFrame, ids: DataFrame, now: dt.datetime) -> DataFrame:
        """``replace`` for any number of segments (``segment_id``), which do not come to the driver; segment_id, customer_count."""
        seq = self.next_seq()
        members = self._write_members(seq, matches.selectExpr("segment_id", "customer_id", f"{instant_literal(now)} AS assigned_at"))
        counted = members.groupBy("segment_id").agg(F.expr("count(*) AS customer_count"))
        rows = ids.distinct().join(counted, "segment_id", "left").selectExpr(
            f"'{REFRESH}' AS kind", "CAST(NULL AS STRING) AS batch", "segment_id",
            "coalesce(customer_count, 0) AS customer_count", f"{instant_literal(now)} AS committed_at",
        )
        self.commit(seq, rows)
        return self.commits().where(f"seq = {seq}").select("segment_id", "customer_count")

    def _write_members(self, seq: int, lists: DataFrame) -> DataFrame:
        path = f"{self.root}/members/seq={seq}"
        grouped = lists.withColumn("segment_group", F.expr(f"pmod(segment_id, {GROUPS})")).hint("rebalance", "segment_group")
        ordered = grouped.sortWithinPartitions("segment_group", "segment_id", "customer_id")
        ordered.write.mode("overwrite").partitionBy("segment_group").parquet(path)
        return self.spark.read.schema(schemas.MEMBERSHIP).parquet(path)

    def change(
        self,
        delta: DataFrame,
        now: dt.datetime,
        batch: str | None = None,
        deadlines: DataFrame | None = None,
        clock: dt.datetime | None = None,
        seq: int | None = None,
        more: Iterable[tuple] = (),
    ) -> int | None:
        """Record assignments and removals.

        ``delta`` has one row (segment_id, customer_id, assigned) per pair. A batch name
        already committed is skipped, so a micro-batch that is replayed after a failure
        takes effect once. Returns the sequence number, None if skipped. ``deadlines`` become visible with the change;
        with ``clock``, those up to then count as dealt with. A write that was begun under ``seq`` ends with this one,
        its commit rows are ``more``.
        """
        with self._writing.lock:
            if batch is not None and self.applied(batch):
                return None
            seq = self.next_seq() if seq is None else seq
            self._write_change(seq, delta, now, batch, [*more, *self._write_deadlines(seq, deadlines, clock)])
            if len(self._visible()[1]) > MOST_CHANGES:
                self.fold_changes()
            self._fold_if_many()
            return seq

    def _write_change(self, seq: int, delta: DataFrame, now: dt.datetime, batch: str | None, more: list[tuple]) -> None:
        rows = delta.selectExpr("segment_id", "customer_id", "assigned", f"{instant_literal(now)} AS assigned_at")
        rows.write.mode("overwrite").parquet(f"{self.root}/changes/seq={seq}")
        touched = [row.segment_id for row in self.changes(seq).select("segment_id").distinct().collect()]
        self.commit(seq, [*((CHANGE, batch, segment_id, None, now) for segment_id in touched or [None]), *more])

    def changes(self, seq: int) -> DataFrame:
        return self.spark.read.schema(_CHANGES).parquet(f"{self.root}/changes/seq={seq}")

    def append_log(self, rows: DataFrame) -> None:
        rows.select(*_columns(schemas.SEGMENT_LOG)).write.mode("append").parquet(f"{self.root}/log/seq=0")


def _merged(rows: DataFrame) -> DataFrame:
    newest = [F.expr("max_by(assigned, seq) AS assigned"), F.expr("max_by(assigned_at, seq) AS assigned_at")]
    return rows.groupBy("segment_id", "customer_id").agg(*newest).where("assigned")


def _of_segments(by_seq: dict[int, list[int]]) -> str:
    return any_of([f"seq = {seq} AND segment_id IN ({', '.join(map(str, ids))})" for seq, ids in by_seq.items()])


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]
