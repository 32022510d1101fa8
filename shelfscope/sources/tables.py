"""Keyed Parquet tables with replace-on-conflict writes.

Spark refuses MERGE on Parquet and cannot overwrite a path it reads, so an upsert writes its batch as a
new part and then publishes, in one new manifest file, which parts make up the table. A write therefore costs
its batch, not the table; readers see the old or the new manifest, never half a write; two
writers racing for one manifest number cannot both win.

Parts are written in folders by bucket of the first key column, so what concerns some keys reads the folders of their buckets alone. A reader of
several parts takes the latest row per key of the later ones and, of the first, the rows these do not replace: the large first part
is filtered where it lies, without an exchange. After ``MAX_PARTS`` upserts the later parts are folded into one, and into the first
once they have grown to ``REWRITE_SHARE`` of it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope import schemas
from shelfscope.functions import text as X
from shelfscope.operators.dedup import last_per_unique_key
from shelfscope.session import stage
from shelfscope.sources import files

MAX_PARTS = 8
REWRITE_SHARE = 0.25
#: Folders of a part. A table keeps the number it was created with.
BUCKETS = 32
#: Keys (some hundred bytes each at most) that are sent to all executors; more are joined by a shuffle. Counted first.
BROADCAST_KEYS = 200_000
BUCKET = "_bucket"


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, name: str, preserve_created_at: bool = False, buckets: int = BUCKETS):
        self.spark, self.name, self.path = spark, name, f"{root}/{name}"
        self.schema, self.keys = schemas.struct(schemas.TABLES[name]), schemas.KEYS[name]
        self.preserve_created_at = preserve_created_at
        self.buckets = buckets

    # manifest -------------------------------------------------------------------------------
    def version(self) -> int:
        """Number of the newest manifest, 0 without one."""
        return max((int(n[:-5]) for n in files.names(self.spark, f"{self.path}/_manifests") if n.endswith(".json")), default=0)

    def _manifest(self, number: int) -> dict:
        if not number:
            return {"parts": [], "rows": {}}
        return {"rows": {}} | json.loads(files.read_text(self.spark, f"{self.path}/_manifests/{number:09d}.json"))

    def _latest(self) -> tuple[int, list[str]]:
        number = self.version()
        return number, self._manifest(number)["parts"]

    def _publish(self, number: int, parts: list[str], rows: dict[str, int]) -> None:
        """``rows`` holds the number of rows of each part, which tells how parts are best read together."""
        known = self._manifest(number - 1)
        kept = {p: n for p, n in (known["rows"] | rows).items() if p in parts}
        text = json.dumps({"parts": parts, "rows": kept, "buckets": known.get("buckets", self.buckets)})
        files.create_text(self.spark, f"{self.path}/_manifests/{number:09d}.json", text)

    def _part(self, name: str) -> str:
        return f"{self.path}/part={name}"

    @staticmethod
    def _new_part(number: int) -> str:
        """Sorts by write order; the suffix keeps two writers out of one folder."""
        return f"{number:09d}-{uuid.uuid4().hex[:8]}"

    def _write_part(self, name: str, rows: DataFrame, buckets: int) -> int:
        """Write ``rows`` in folders by bucket; how many there are."""
        laid = rows.withColumn(BUCKET, bucket_of(F.col(self.keys[0]), buckets)).hint("rebalance", BUCKET)
        laid.write.partitionBy(BUCKET).parquet(self._part(name))
        if not any(n.startswith(f"{BUCKET}=") for n in files.names(self.spark, self._part(name))):
            return 0
        return self.spark.read.schema(self.schema).parquet(self._part(name)).count()  # from the files' footers

    def exists(self) -> bool:
        return self.version() > 0

    # reading --------------------------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        manifest = self._manifest(self.version() if version is None else version)
        return self._rows(manifest["parts"], manifest["rows"])

    def of_keys(self, keys: DataFrame) -> DataFrame:
        """Rows whose first key column is listed in that of ``keys``, from the folders of these alone."""
        manifest = self._manifest(self.version())
        wanted = stage(keys.select(self.keys[0]).distinct())
        rows = self._rows(manifest["parts"], manifest["rows"], self._buckets_of(wanted, manifest))
        return rows.join(self._sent(wanted, wanted.count()), self.keys[0], "left_semi")

    def _buckets_of(self, keys: DataFrame, manifest: dict) -> list[int]:
        """At most as many numbers as a part has folders."""
        number = bucket_of(F.col(self.keys[0]), manifest.get("buckets", self.buckets))
        return sorted(r[0] for r in keys.select(number.alias("n")).distinct().collect())

    @staticmethod
    def _sent(keys: DataFrame, count: int) -> DataFrame:
        return F.broadcast(keys) if count <= BROADCAST_KEYS else keys

    @staticmethod
    def _count(parts: list[str], counts: dict[str, int]) -> int:
        """Rows of parts; a part of unknown size counts as a large one."""
        return sum(counts.get(p, BROADCAST_KEYS + 1) for p in parts)

    def _rows(self, parts: list[str], counts: dict[str, int], buckets: list[int] | None = None) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        base = self._part_rows(parts[0], buckets)
        if len(parts) == 1:
            return base
        later = None
        for part in parts[1:]:
            rows = self._part_rows(part, buckets).withColumn("part", F.lit(part))
            later = rows if later is None else later.unionByName(rows)
        # A key with a NULL is like no other, here as in any join.
        replaced = self._sent(later.select(*self.keys), self._count(parts[1:], counts))
        kept = base.join(replaced, self.keys, "left_anti")
        latest = last_per_unique_key(later, self.keys, ["part"]).drop("part")
        if self.preserve_created_at:
            copies = later.select(*self.keys, "created_at").unionByName(base.select(*self.keys, "created_at").join(replaced, self.keys, "left_semi"))
            born = copies.dropna(subset=self.keys).groupBy(*self.keys).agg(F.min("created_at").alias("_born"))
            latest = latest.join(born, self.keys, "left").withColumn("created_at", F.coalesce("_born", "created_at"))
        return kept.unionByName(latest.select(*self.schema.names))

    def _part_rows(self, part: str, buckets: list[int] | None = None) -> DataFrame:
        """A part in the table's columns; one written before a column was added holds that column's default."""
        stored = self.spark.read.parquet(self._part(part))
        if buckets is not None:
            stored = stored.where(F.col(BUCKET).isin(buckets))
        if set(self.schema.names) <= set(stored.columns):
            return stored.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        return migrate(stored, self.name).select(*(F.col(f.name).cast(f.dataType) for f in self.schema))

    def changes(self, since: int, upto: int | None = None) -> DataFrame:
        """The rows that versions ``since`` and ``upto`` differ in, with ``change``: -1 as they were, 1 as they are.

        A key of a part that only one of them has is looked up in both, in the folders of such keys. A row that was merely folded comes
        with both signs. The manifests must not have been purged.
        """
        old, new = self._manifest(since), self._manifest(self.version() if upto is None else upto)
        if new["parts"][: len(old["parts"])] == old["parts"] and not self.preserve_created_at:
            return self._added(old, new)
        keyless = " OR ".join(f"{k} IS NULL" for k in self.keys)
        only = {-1: [p for p in old["parts"] if p not in new["parts"]], 1: [p for p in new["parts"] if p not in old["parts"]]}
        counts = old["rows"] | new["rows"]
        out = self.spark.createDataFrame([], self.schema).withColumn("change", F.lit(1))
        if not only[-1] and not only[1]:
            return out
        touched = None
        for part in only[-1] + only[1]:
            keys = self._part_rows(part).select(*self.keys)
            touched = keys if touched is None else touched.unionByName(keys)
        touched = stage(touched.distinct())
        buckets, sent = self._buckets_of(touched, new), self._sent(touched, self._count(only[-1] + only[1], counts))
        for sign, manifest in ((-1, old), (1, new)):
            rows = self._rows(manifest["parts"], manifest["rows"], buckets).join(sent, self.keys, "left_semi")
            for part in only[sign]:
                rows = rows.unionByName(self._part_rows(part).where(keyless))
            out = out.unionByName(rows.withColumn("change", F.lit(sign)))
        return out

    def _added(self, old: dict, new: dict) -> DataFrame:
        """``changes`` between versions of which the newer only has more parts: rows as they are lie in these, and only rows as they were
        are looked up in the older version."""
        parts, counts = new["parts"][len(old["parts"]) :], old["rows"] | new["rows"]
        out = self._rows(parts, counts).withColumn("change", F.lit(1))
        if not old["parts"] or not parts:
            return out
        buckets, keys = set(), None
        for part in parts:
            buckets |= {int(n.split("=")[1]) for n in files.names(self.spark, self._part(part)) if n.startswith(f"{BUCKET}=")}
            own = self._part_rows(part).select(*self.keys)
            keys = own if keys is None else keys.unionByName(own)
        rows = self._rows(old["parts"], counts, sorted(buckets))
        return out.unionByName(rows.join(self._sent(keys, self._count(parts, counts)), self.keys, "left_semi").withColumn("change", F.lit(-1)))

    def changed_keys(self, since: int, upto: int) -> DataFrame:
        """What ``changes`` has in its first key column, some more than once, from the parts that only one of the versions has."""
        old, new = self._manifest(since)["parts"], self._manifest(upto)["parts"]
        out = self.spark.createDataFrame([], self.schema).select(self.keys[0])
        for part in [p for p in old if p not in new] + [p for p in new if p not in old]:
            out = out.unionByName(self._part_rows(part).select(self.keys[0]))
        return out

    # writing --------------------------------------------------------------------------------
    def create(self) -> "KeyedTable":
        """Publish an empty table unless there is one."""
        if not self.exists():
            self._publish(1, [], {})
        return self

    def migrate_from(self, rows: DataFrame) -> "KeyedTable":
        """Take up the rows of an older table, whatever columns it lacked, as the first part of a new one."""
        if self.exists():
            raise ValueError(f"{self.path} holds a table already")
        self.create()
        return self.upsert(migrate(rows, self.name))

    def conform(self, rows: DataFrame) -> DataFrame:
        """Records to the table's columns: missing ones take their defaults, flags become 0/1, both
        timestamps are this write's time."""
        defaults, now = schemas.DEFAULTS[self.name], F.current_timestamp()
        out: list[Column] = []
        for field in self.schema:
            present = field.name in rows.columns
            default = F.lit(defaults.get(field.name))
            if field.name in ("created_at", "updated_at"):
                value = F.coalesce(F.col(field.name), now) if present else now
            elif not present:
                value = default
            elif rows.schema[field.name].dataType.simpleString() == "boolean":
                value = X.flag(F.col(field.name))
            else:
                value = F.col(field.name)
            out.append(value.cast(field.dataType).alias(field.name))
        return rows.select(*out, *[c for c in ("seq",) if c in rows.columns])

    def upsert(self, rows: DataFrame) -> "KeyedTable":
        """Replace rows of the same key and add the others.

        Of rows in the batch that share a key, the one with the highest ``seq`` counts. Without that column, or
        where it ties, one of them does, chosen by a hash of the row, so the same batch always leaves the same table.
        """
        number, parts = self._latest()
        batch = self.conform(rows)
        content = [c for c in self.schema.names if c not in ("created_at", "updated_at")]
        hashed = batch.withColumn("_hash", F.xxhash64(*content))
        order = ["seq", "_hash"] if "seq" in batch.columns else ["_hash"]
        batch = last_per_unique_key(hashed, self.keys, order).drop("seq", "_hash")
        part = self._new_part(number + 1)
        count = self._write_part(part, batch, self._manifest(number).get("buckets", self.buckets))
        if not count:
            files.remove(self.spark, self._part(part))
            return self
        self._publish(number + 1, [*parts, part], {part: count})
        if len(parts) + 1 > MAX_PARTS:
            base, *later = self._latest()[1]
            grown = sum(files.size(self.spark, self._part(p)) for p in later)
            self._fold(whole=grown >= REWRITE_SHARE * files.size(self.spark, self._part(base)))
        return self

    def append_new(self, rows: DataFrame) -> "KeyedTable":
        """Add only rows whose key is not stored yet."""
        fresh = rows.dropDuplicates(self.keys).join(self.read().select(*self.keys), self.keys, "left_anti")
        return self.upsert(fresh)

    def fold(self) -> "KeyedTable":
        """Write the current rows as a single part."""
        return self._fold(whole=True)

    def _fold(self, whole: bool) -> "KeyedTable":
        number, parts = self._latest()
        kept, folded = ([], parts) if whole else (parts[:1], parts[1:])
        if len(folded) > 1:
            part = self._new_part(int(folded[-1][:9]))  # takes the place of the last part folded into it
            manifest = self._manifest(number)
            count = self._write_part(part, self._rows(folded, manifest["rows"]), manifest.get("buckets", self.buckets))
            self._publish(number + 1, [*kept, part], {part: count})
        return self

    def reset(self, confirm: bool = False) -> "KeyedTable":
        """Empty the table, keeping its schema."""
        if not confirm:
            raise ValueError("emptying a table needs confirm=True")
        self._publish(self._latest()[0] + 1, [], {})
        return self

    def purge(self) -> "KeyedTable":
        """Delete older manifests, and parts the current one no longer names; run when no reader is on an older one."""
        live = {f"part={p}" for p in self._latest()[1]}
        for name in files.names(self.spark, self.path):
            if name.startswith("part=") and name not in live:
                files.remove(self.spark, f"{self.path}/{name}")
        newest = self._latest()[0]
        for name in files.names(self.spark, f"{self.path}/_manifests"):
            if name.endswith(".json") and int(name[:-5]) < newest:
                files.remove(self.spark, f"{self.path}/_manifests/{name}")
        return self


class Store:
    """The four tables below one folder."""

    def __init__(self, spark: SparkSession, root: str, preserve_created_at: bool = False, buckets: int = BUCKETS):
        self.spark, self.root = spark, root
        self.tables = {n: KeyedTable(spark, root, n, preserve_created_at, buckets) for n in schemas.TABLES}

    def create(self) -> "Store":
        for table in self.tables.values():
            table.create()
        return self

    def __getitem__(self, name: str) -> KeyedTable:
        return self.tables[name]

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def reset(self, confirm: bool = False) -> DataFrame:
        """Empty every existing table; (table_name, rows_before, rows_after) of each."""
        before = {n: t.read() for n, t in self.tables.items() if t.exists()}
        for name in before:
            self.tables[name].reset(confirm)
        out = self.spark.createDataFrame([], "table_name string, rows_before bigint, rows_after bigint")
        for name, rows in before.items():
            was = rows.agg(F.count("*").alias("rows_before"))
            now = self.read(name).agg(F.count("*")).scalar()
            out = out.unionByName(was.select(F.lit(name).alias("table_name"), "rows_before", now.alias("rows_after")))
        return out


def migrate(rows: DataFrame, table: str) -> DataFrame:
    """Add the columns an older file lacks, with their defaults; columns already there are untouched."""
    defaults = schemas.DEFAULTS[table]
    missing = [f for f in schemas.struct(schemas.TABLES[table]) if f.name not in rows.columns]
    return rows.withColumns({f.name: F.lit(defaults.get(f.name)).cast(f.dataType) for f in missing})
