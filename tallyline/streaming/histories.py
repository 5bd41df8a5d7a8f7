"""Histories kept up to date: a state row per entity, moved on by every batch of new rows.

A batch (a day, as a rule) is worked out alone, as if nothing had been before; then every row is corrected by what its entity's
state knew: totals are added, an EWM v before the batch adds r^j * (v - x0) to the j-th row, where x0 is the entity's first
value in the batch, with which the batch's own EWM was seeded. The cost follows the batch and the states of the parts it
touches, not the history.

States are versioned by batch and part (a season, say): a batch reads the last version before its own number and writes a new
one, so a batch that is delivered again, or half written, gives the same result. Only the two last versions are kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.operators.history import as_clock, ewm_factors, running_state, zero
from tallyline.session import drop_scratch, scratch_path

KEPT_VERSIONS = 2


class HistoryFeed:
    """The state tables and results under ``root``. ``part`` is one of the entity's columns, or None.

    ``sums``, ``ewms``, ``latest``, ``order`` and ``clock`` are those of ``running_state``.
    """

    def __init__(self, spark: SparkSession, root: str, entity: Sequence[str], order: Sequence[str], *, sums: Mapping[str, str] | None = None,
                 ewms: Mapping[str, tuple[str, float]] | None = None, latest: Mapping[str, str] | None = None, clock: str = "game_date", part: str | None = None):
        if part is not None and part not in entity:
            raise ValueError(f"{part} is not a column of the entity")
        self.spark, self.root, self.entity, self.order = spark, root.rstrip("/"), list(entity), list(order)
        self.sums, self.ewms, self.latest = dict(sums or {}), dict(ewms or {}), dict(latest or {})
        self.clock, self.part = clock, part

    def _children(self, path: str) -> list[str]:
        of = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = of(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in files.listStatus(of(path))] if files.exists(of(path)) else []

    def _versions(self, place: str) -> list[int]:
        """Complete versions of a part's state, the oldest first."""
        found = [int(c[2:]) for c in self._children(place) if c.startswith("v=")]
        return sorted(v for v in found if "_SUCCESS" in self._children(f"{place}/v={v}"))

    def _places(self, batch: DataFrame) -> dict:
        """Folder of every part that the batch touches."""
        if self.part is None:
            return {None: f"{self.root}/state/all"}
        values = [r[0] for r in batch.select(self.part).distinct().collect()]  # seasons: few
        return {v: f"{self.root}/state/{self.part}={v}" for v in values}

    def state(self, places: Mapping, before: int) -> DataFrame | None:
        paths = [f"{p}/v={max(v)}" for p in places.values() if (v := [x for x in self._versions(p) if x < before])]
        return self.spark.read.parquet(*paths) if paths else None

    def _ends(self, inner: DataFrame, x: Mapping[str, str]) -> DataFrame:
        """One row per entity of the batch: its first values, and sums, EWMs and maxima after its last row."""
        named = inner.selectExpr("*", f"{as_clock(inner, self.clock)} AS __clock", *[f"{e} AS __x_{n}" for n, e in x.items()], *[f"{e} AS __d_{n}" for n, e in self.latest.items()])
        firsts = [f"max(if(seq = 0, __x_{n}, NULL)) AS __first_{n}" for n in self.ewms]
        last = ", ".join(["seq", *self.sums, *self.ewms, *self.latest, *[f"__x_{n}" for n in x], *[f"__d_{n}" for n in self.latest]])
        ends = named.groupBy(*self.entity).agg(
            *[F.expr(e) for e in firsts], F.expr("count(1) AS __m"), F.expr("min(__clock) AS __from"), F.expr("max(__clock) AS __to"), F.expr(f"max_by(struct({last}), seq) AS __last"))
        after = [f"coalesce(__last.{n}, 0D) + __last.__x_{n} AS __after_{n}" for n in self.sums]
        for n, (_, h) in self.ewms.items():
            r, alpha = ewm_factors(h)
            after.append(f"if(__m = 1, __first_{n}, {r!r}D * __last.{n} + {alpha!r}D * __last.__x_{n}) AS __after_{n}")
        after += [f"greatest(__last.{n}, __last.__d_{n}) AS __after_{n}" for n in self.latest]
        return ends.selectExpr(*self.entity, "__m", "__from", "__to", *[f"__first_{n}" for n in self.ewms], *after)

    def _staged(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(self.spark, "batch")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def ingest(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Store and return the batch's rows with ``seq`` and the state of all earlier rows, of this batch and before.

        Every row must come after all rows of its entity in earlier batches, by the clock at least; late rows raise.
        """
        places = self._places(batch)
        old = self.state(places, batch_id)
        # read for its ends and for its rows: stored, the batch is read and put in order once
        inner, staged = self._staged(running_state(batch, self.entity, self.order, sums=self.sums, ewms=self.ewms, latest=self.latest, clock=self.clock))
        x = {n: zero(t) for n, t in self.sums.items()} | {n: zero(t) for n, (t, _) in self.ewms.items()}
        ends = self._ends(inner, x)
        kept = {"__n": "bigint", "__clock_to": "bigint"} | {f"__s_{n}": "double" for n in [*self.sums, *self.ewms]}
        kinds = dict(inner.dtypes)
        kept |= {f"__s_{n}": kinds[n] for n in self.latest}
        if old is None:
            joined = ends.selectExpr("*", *[f"cast(NULL as {t}) AS {c}" for c, t in kept.items()])
        else:
            joined = ends.join(old.select(*self.entity, *kept), self.entity, "left")
        joined, ends_staged = self._staged(joined)  # a row per entity, read for the check, the rows and the state
        late = joined.where("__from < __clock_to").first()
        if late is not None:
            raise ValueError(f"rows of {[late[c] for c in self.entity]} come before those of an earlier batch")

        known = joined.select(*self.entity, "__n", *[f"__first_{n}" for n in self.ewms], *[c for c in kept if c.startswith("__s_")])
        rows = inner.withColumnsRenamed({c: f"__in_{c}" for c in ["seq", *self.sums, *self.ewms, *self.latest]}).join(known, self.entity)
        count = "coalesce(__n, 0L)"
        out = [f"{count} + __in_seq AS seq"]
        out += [f"CASE WHEN {count} + __in_seq > 0 THEN coalesce(__s_{n}, 0D) + coalesce(__in_{n}, 0D) END AS {n}" for n in self.sums]
        for n, (_, h) in self.ewms.items():
            r, _ = ewm_factors(h)
            out.append(f"CASE WHEN {count} = 0 THEN __in_{n} WHEN __in_seq = 0 THEN __s_{n} ELSE __in_{n} + pow({r!r}D, __in_seq) * (__s_{n} - __first_{n}) END AS {n}")
        out += [f"greatest(__s_{n}, __in_{n}) AS {n}" for n in self.latest]
        target = f"{self.root}/rows/batch={batch_id}"
        rows.selectExpr(*batch.columns, *out).write.mode("overwrite").parquet(target)

        moved = [f"{count} + __m AS __n", "__to AS __clock_to"]
        moved += [f"coalesce(__s_{n}, 0D) + __after_{n} AS __s_{n}" for n in self.sums]
        for n, (_, h) in self.ewms.items():
            r, _ = ewm_factors(h)
            moved.append(f"if({count} = 0, __after_{n}, __after_{n} + pow({r!r}D, __m) * (__s_{n} - __first_{n})) AS __s_{n}")
        moved += [f"greatest(__s_{n}, __after_{n}) AS __s_{n}" for n in self.latest]
        new = joined.selectExpr(*self.entity, *moved)
        if old is not None:
            new = new.unionByName(old.join(joined.select(*self.entity), self.entity, "left_anti").select(new.columns))
        for value, place in places.items():
            mine = new if self.part is None else new.where(F.col(self.part).eqNullSafe(F.lit(value)))
            mine.write.mode("overwrite").parquet(f"{place}/v={batch_id}")
            for v in self._versions(place)[:-KEPT_VERSIONS]:
                drop_scratch(self.spark, f"{place}/v={v}")
        for path in (staged, ends_staged):
            drop_scratch(self.spark, path)
        return self.spark.read.parquet(target)

    def rows(self) -> DataFrame:
        """The results of all batches."""
        return self.spark.read.option("basePath", f"{self.root}/rows").parquet(f"{self.root}/rows").drop("batch")

    def follow(self, rows: DataFrame, checkpoint: str):
        """Start a query that ingests every micro-batch of a stream; it stops after the rows that are there."""
        return (
            rows.writeStream.foreachBatch(lambda batch, number: None if batch.isEmpty() else self.ingest(batch, number))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
