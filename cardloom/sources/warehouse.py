"""The priced fact as a stored table: a folder a month, bucketed by merchant, repriced a changed month at a time.

What a purchase was priced with is stored beside it, as rates of few different values; the amounts of money, of which no two are
alike, follow from them by arithmetic when they are read. Purchases are dealt to buckets before they meet their rates, and a
slice of them at a time, so that what is shuffled on the way is a slice's and not all purchases'.

Months are pruned by folder. Joins and groupings by merchant read buckets as they lie, without a shuffle of the fact.
A manifest beside the table has, for each month, a digest of the purchases (with their pricing model) that it was priced
from, a digest of the prices, and a stamp of the input files:

- the same stamp: nothing is read;
- other files: purchases are digested by month, and only months whose digest differs are priced and overwritten;
- other prices: every month is.

What reads the purchases once doesn't store them: priced() reads the store where there is one, and else prices on the way.

The manifest is written after the table, so that a run that breaks off is made good by the next one. Months are the
only thing that is listed on the driver.
"""

from __future__ import annotations

import datetime
import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bridge
from .scratch import cleared, dropped, kept, shared

#: What bridge.transactions and bridge.merchants read.
INPUTS = ("lineitem", "orders", "customer", "supplier", "nation", "part")
#: Purchases of all months that a bucket should hold; the number of buckets is a power of two.
BUCKET_ROWS, FEWEST, MOST = 20_000_000, 8, 8192
#: Purchases that are shuffled at once, few enough that tasks sort a bucket's in memory; a slice more is a file more a bucket and month.
SLICE_ROWS = 10_000_000
#: Purchases of a part where they are priced as they are read: few enough that a task joins and groups them in memory.
PART_ROWS = 500_000
#: Columns of purchases that are another's copy: not stored, but read from that.
COPIES = {"l_partkey": "merchant_id", "l_suppkey": "shop_id"}
MANIFEST = "txn_month date, n bigint, low bigint, mixed bigint, prices string, stamp string, buckets int"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm, True)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)


def stamp(spark: SparkSession, sf_dir: str, tables=INPUTS) -> str:
    """A digest of the tables' sizes, numbers of files and times of change: a few calls to the file system a table."""
    seen = []
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size, status = fs.getContentSummary(path), fs.getFileStatus(path)
        seen.append((name, size.getLength(), size.getFileCount(), status.getModificationTime()))
    return hashlib.sha256(repr(seen).encode()).hexdigest()


def month() -> F.Column:
    return F.trunc("txn_date", "MM")


def digests(purchases: DataFrame, columns: list[str], by: str = "txn_month") -> DataFrame:
    """For each month the number of rows and two sums of their hashes, in which the order of rows plays no part."""
    row = F.xxhash64(*(F.col(c) for c in columns))
    return purchases.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("low"), F.bit_xor(row).alias("mixed"))


def digest_of(tables: dict[str, DataFrame]) -> str:
    """One digest of small tables, whatever the order of their rows, in one pass."""
    rows = None
    for name, table in sorted(tables.items()):
        columns = sorted(table.columns)
        one = table.select(F.lit(f"{name}({', '.join(columns)})").alias("name"), F.xxhash64(*(F.col(c).cast("string") for c in columns)).alias("row"))
        rows = one if rows is None else rows.union(one)
    found = rows.groupBy("name").agg(F.count("*"), F.bit_xor("row"), F.sum(F.pmod("row", F.lit(1 << 31)))).collect()  # a row a table
    return hashlib.sha256(repr(sorted(map(tuple, found))).encode()).hexdigest()


class FactStore:
    """A stored fact in a folder that driver and executors share; `derive` makes it from what is stored, by columns alone."""

    def __init__(self, spark: SparkSession, folder: str, derive: Callable[[DataFrame], DataFrame] | None = None, slice_rows: int = SLICE_ROWS) -> None:
        self.spark, self.folder, self.derive, self.slice_rows = spark, folder, derive, slice_rows
        self.table = "fct_" + hashlib.sha256(folder.encode()).hexdigest()[:16]

    def manifest(self) -> DataFrame | None:
        path = f"{self.folder}/manifest"
        return self.spark.read.schema(MANIFEST).parquet(path) if _exists(self.spark, f"{path}/_SUCCESS") else None

    def stored(self) -> DataFrame:
        return self.spark.table(self.table)

    def read(self) -> DataFrame:
        return self.derive(self.stored()) if self.derive else self.stored()

    def _register(self, schema: StructType, buckets: int) -> None:
        """Make the folder known to this session's catalog, which may not have written it."""
        if self.spark.catalog.tableExists(self.table):
            return
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(f"create table {self.table} ({columns}) using parquet partitioned by (txn_month) clustered by (merchant_id) sorted by (merchant_id) into {buckets} buckets location '{self.folder}/fct' options ('compression' 'zstd')")
        if _exists(self.spark, f"{self.folder}/fct"):
            self.spark.catalog.recoverPartitions(self.table)

    def _write_manifest(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest")

    def _manifest_of(self, inputs: list[str], prices: str, stamped: str, buckets: int) -> None:
        found = digests(self.stored(), inputs).select("txn_month", "n", "low", "mixed", F.lit(prices).alias("prices"), F.lit(stamped).alias("stamp"), F.lit(buckets).alias("buckets"))
        self._write_manifest([tuple(r) for r in found.collect()])  # a row a month

    def refresh(self, purchases: DataFrame | Callable[[int], DataFrame], models: DataFrame, prices: dict[str, DataFrame], price: Callable[[DataFrame], DataFrame], stamped: str = "", rows: int | None = None, apart: str | None = None) -> list[datetime.date]:
        """Bring the table up to its inputs; the months that were priced for it.

        purchases have txn_date; a function gives them dealt to a number of partitions by merchant_id. models: merchant_id,
        pricing_model, for purchases that have none; prices: the tables that `price` reads; price makes what is stored, with
        all of the purchases' columns and pricing_model, from such purchases, and keeps them dealt as they are. rows: how many
        they are, if that is known; apart: a column, best one that they are joined by, by which they are cut into slices.
        """
        deal = purchases if callable(purchases) else lambda parts: purchases.repartition(parts, "merchant_id")
        old = self.manifest()
        known = {r["txn_month"]: r for r in old.collect()} if old is not None else {}
        inputs = [*sorted(c for c in deal(1).columns if c != "pricing_model"), "pricing_model"]
        if known:
            buckets = next(iter(known.values()))["buckets"]
            self._register(self._priced(deal(buckets), models, price, buckets).schema, buckets)
            if stamped and next(iter(known.values()))["stamp"] == stamped:
                return []
        digest = digest_of(prices)
        # written once: worked out anew, ranks of all merchants would be shuffled for each slice
        models = kept(models.select("merchant_id", "pricing_model"), "models")
        try:
            return self._refreshed(deal, models, prices, price, stamped, rows, apart, known, inputs, digest)
        finally:
            dropped(models)

    def _refreshed(self, deal: Callable[[int], DataFrame], models: DataFrame, prices: dict[str, DataFrame], price: Callable[[DataFrame], DataFrame], stamped: str, rows: int | None, apart: str | None, known: dict, inputs: list[str], digest: str) -> list[datetime.date]:
        """refresh() with the models written, the months that the manifest knows, the purchases' columns and the prices' digest."""
        buckets = next(iter(known.values()))["buckets"] if known else 0
        if not known:
            rows = deal(FEWEST).count() if rows is None else rows
            buckets = min(MOST, max(FEWEST, 1 << (rows // BUCKET_ROWS).bit_length()))
            self.spark.sql(f"drop table if exists {self.table}")
            _delete(self.spark, f"{self.folder}/fct")
            self._register(self._priced(deal(buckets), models, price, buckets).schema, buckets)
            for some in self._slices(deal(buckets), rows, apart):
                self._insert(some, models, price, buckets)
            self._manifest_of(inputs, digest, stamped, buckets)
            return sorted(r["txn_month"] for r in self.manifest().collect())
        now: dict[datetime.date, tuple[int, int, int]] = {}
        for some in self._slices(deal(buckets), sum(r["n"] for r in known.values()), apart):
            current = self._modelled(some.drop("pricing_model"), models, buckets).withColumn("txn_month", month())
            for m, n, low, mixed in digests(current, inputs).collect():  # a row a month
                before = now.get(m, (0, 0, 0))
                now[m] = before[0] + n, before[1] + low, before[2] ^ mixed
        same = lambda r, b: b is not None and digest == b["prices"] and r == (b["n"], b["low"], b["mixed"])
        changed = sorted(m for m, r in now.items() if not same(r, known.get(m)))
        gone = [m for m in known if m not in now or m in changed]
        if gone:  # first from the manifest, so that a run that breaks off leaves no month that only seems to be there
            self._write_manifest([tuple(r) for m, r in known.items() if m not in gone])
        for m in gone:
            self.spark.sql(f"alter table {self.table} drop if exists partition (txn_month = date '{m}')")
            _delete(self.spark, f"{self.folder}/fct/txn_month={m}")
        if changed:
            for some in self._slices(deal(buckets).where(month().isin(changed)), sum(now[m][0] for m in changed), apart):
                self._insert(some, models, price, buckets)
        self._manifest_of(inputs, digest, stamped, buckets)
        return changed

    def _slices(self, dealt: DataFrame, rows: int, apart: str | None) -> Iterator[DataFrame]:
        """The purchases in about equal slices; what was shuffled for one is cleared before the next is taken."""
        number = max(1, -(-rows // self.slice_rows)) if apart else 1
        for k in range(number):
            yield dealt if number == 1 else dealt.where(F.pmod(F.xxhash64(apart), F.lit(number)) == k)
            cleared(self.spark)

    def _modelled(self, dealt: DataFrame, models: DataFrame, buckets: int) -> DataFrame:
        from ..operators import waterfall  # which reads this package

        return waterfall.modelled(dealt, models, buckets)

    def _priced(self, dealt: DataFrame, models: DataFrame, price: Callable[[DataFrame], DataFrame], buckets: int) -> DataFrame:
        return price(self._modelled(dealt, models, buckets)).withColumn("txn_month", month())

    def _insert(self, dealt: DataFrame, models: DataFrame, price: Callable[[DataFrame], DataFrame], buckets: int) -> None:
        """A task writes a bucket: one file for each of its months. Months of the rows have no files of before, or this run's."""
        self.spark.sql(f"refresh table {self.table}")
        self._priced(dealt, models, price, buckets).select(self.stored().columns).write.mode("append").insertInto(self.table)


def purchases(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    """A data folder's purchases as a store takes them: dealt, without COPIES."""
    return bridge.transactions(spark, sf_dir, parts).drop(*COPIES)


def derived(stored: DataFrame) -> DataFrame:
    """Stored purchases with COPIES, after the number of their line, and amounts of money."""
    from ..operators import waterfall  # which reads this package

    at = stored.columns.index("l_linenumber") + 1
    return waterfall.amounts(stored.select(*stored.columns[:at], *(F.col(c).alias(name) for name, c in COPIES.items()), *stored.columns[at:]))


def store_of(spark: SparkSession, sf_dir: str) -> FactStore:
    """The store that this application's queries over a data folder share."""
    name = hashlib.sha256(sf_dir.encode()).hexdigest()[:16]
    return FactStore(spark, f"{shared(spark)}/warehouse-{spark.sparkContext.applicationId}-{name}", derived)


#: Stamps that this process brought its own stores up to; nobody else writes them.
_seen: dict[str, str] = {}


def current(spark: SparkSession, sf_dir: str) -> DataFrame | None:
    """The stored fact of a data folder, if this application has stored its purchases as they are now."""
    store = store_of(spark, sf_dir)
    return store.read() if _seen.get(store.folder) == stamp(spark, sf_dir) and spark.catalog.tableExists(store.table) else None


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priced purchases for what reads them once: as stored, if they are; else priced as they are read, dealt by merchant_id.

    To store all columns of all purchases takes several times as long as to price the few that a query reads.
    """
    from ..operators import waterfall

    if (stored := current(spark, sf_dir)) is not None:
        return stored
    out = waterfall.rated(_dealt(spark, sf_dir), waterfall.Prices.configured(spark, bridge.acquirers(spark, sf_dir)))
    return derived(out.select("merchant_id", *(c for c in out.columns if c != "merchant_id")).withColumn("txn_month", month()))


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with their pricing model, without COPIES, dealt by merchant_id into parts of PART_ROWS."""
    from ..operators import waterfall

    parts = min(MOST, max(FEWEST, -(-bridge.read(spark, sf_dir, "lineitem").count() // PART_ROWS)))
    return waterfall.modelled(purchases(spark, sf_dir, parts), bridge.merchants(spark, sf_dir), parts)


def written(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(purchases, fact) for one query that reads them several times: purchases are written, and priced anew by each read.

    Price tables are broadcast, so that a read shuffles nothing for them; months, buckets and digests are a store's matter.
    """
    from ..operators import waterfall

    if (stored := current(spark, sf_dir)) is not None:
        return bridge.transactions(spark, sf_dir), stored
    found = kept(_dealt(spark, sf_dir), "purchases").withColumns({name: F.col(c) for name, c in COPIES.items()})
    prices = waterfall.Prices.configured(spark, bridge.acquirers(spark, sf_dir))
    return found.drop("pricing_model"), waterfall.price(found, prices).withColumn("txn_month", month())


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priced purchases of a data folder, priced when they, or the prices, have changed since they were last asked for."""
    from ..operators import waterfall

    if (stored := current(spark, sf_dir)) is not None:
        return stored
    store, now = store_of(spark, sf_dir), stamp(spark, sf_dir)
    merchants = bridge.merchants(spark, sf_dir)
    prices = waterfall.Prices.configured(spark, bridge.acquirers(spark, sf_dir))
    store.refresh(
        lambda parts: purchases(spark, sf_dir, parts), merchants, {n: getattr(prices, n) for n in prices.__dataclass_fields__},
        lambda some: waterfall.rated(some, prices), now, bridge.read(spark, sf_dir, "lineitem").count(), "l_orderkey",
    )
    _seen[store.folder] = now
    return store.read()
