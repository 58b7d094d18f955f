"""Term bags of records: how distinctive a term is, and how often every term occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.skew import keyed_lookup
from ..plans.versions import Versions
from ..plans.workspace import Workspace, delete_path

#: Rows of one record that one task takes; a record with more of them, and more than this share of all, is hot.
HOT_ROWS, HOT_SHARE = 10_000, 1e-5
#: Stands for the record itself among its terms, so that records are counted as terms are. (No term is empty.)
RECORD = ""
_HEAD = -(1 << 63)


def ranked_builds(chunk_terms: DataFrame, most: int = 1) -> DataFrame:
    """``(chunk_ord, build_no, back, e)``: distinct rows, ``back`` 1 for a chunk's highest build, 2 for the next, up to ``most``.

    Rows with a null ``chunk_ord`` belong to no record and are dropped; a null
    ``build_no`` counts as lower than any other; a null map is an empty one.
    Equal maps are duplicates whatever the order of their entries.

    A record's rows meet in one task, by one shuffle. A record with very many
    rows, which are counted first, is freed of copies where it lies and
    then in many tasks, and loses its lower builds before its rows meet.
    """
    rows = chunk_terms.where(F.col("chunk_ord").isNotNull()).select("chunk_ord", "shard_no", "build_no", F.map_entries("term_frequencies").alias("e"))
    order = Window.partitionBy("chunk_ord").orderBy(F.col("build_no").desc_nulls_last())
    in_order = F.array_sort("e")
    sizes = rows.groupBy("chunk_ord").count()
    total = sizes.agg(F.sum("count"), F.max("count")).first()
    limit = max(HOT_ROWS, (total[0] or 0) * HOT_SHARE)
    hot = None
    if (total[1] or 0) > limit:
        names = F.broadcast(sizes.where(F.col("count") > limit).select("chunk_ord"))  # fewer than 1 / HOT_SHARE
        hot = rows.join(names, "chunk_ord", "left_semi").withColumn("e", in_order).distinct()
        hot = hot.withColumn("back", F.dense_rank().over(order)).where(F.col("back") <= most)
        rows = rows.join(names, "chunk_ord", "left_anti")
    same = Window.partitionBy("chunk_ord", "shard_no", "build_no")
    rows = rows.repartition("chunk_ord").withColumn("back", F.dense_rank().over(order)).where(F.col("back") <= most)
    # entries are put in order only where there may be copies
    rows = rows.withColumn("e", F.when(F.count(F.lit(1)).over(same) > 1, in_order).otherwise(F.col("e")))
    rows = rows.groupBy("chunk_ord", "shard_no", "build_no", "back", "e").agg(F.lit(1).alias("one")).drop("one")
    return (rows if hot is None else rows.unionByName(hot)).select("chunk_ord", "build_no", "back", "e")


def with_record(rows: DataFrame) -> DataFrame:
    """Entries ``e`` of rows with terms get one more, for the record itself; ``row_sum`` is the sum of the row's counts."""
    counted = F.aggregate("e", F.lit(0).cast("long"), lambda n, x: n + F.when((x["value"] >= 1) & (F.trim(x["key"]) != ""), x["value"]).otherwise(0))
    head = F.array(F.struct(F.lit(RECORD).alias("key"), F.lit(_HEAD).alias("value")))
    rows = rows.withColumn("row_sum", F.coalesce(counted, F.lit(0).cast("long")))
    return rows.withColumn("e", F.when(F.col("row_sum") > 0, F.concat("e", head)))


def bag_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, term, tf)`` of rows from ``with_record``: counts above 0 added up over the spellings of a term, and a row for the record itself.

    A term is its key without blanks at both ends and in lower case; what is
    left empty, and a null key, is no term. The record's row has the term
    ``RECORD``; a record without terms has none.
    """
    flat = rows.select(*keys, F.explode("e").alias("kv"))
    head = (F.col("kv.value") == _HEAD) & (F.col("kv.key") == RECORD)
    flat = flat.where((F.col("kv.value") >= 1) | head)
    flat = flat.select(*keys, F.lower(F.trim("kv.key")).alias("term"), F.greatest("kv.value", F.lit(1)).alias("c"), head.alias("head"))
    return flat.where((F.col("term") != "") | F.col("head")).groupBy(*keys, "term").agg(F.sum("c").alias("tf"))


def latest_bags(chunk_terms: DataFrame) -> DataFrame:
    """``(chunk_ord, row_sum, term, tf)`` of the rows with each chunk's highest build, and a row for each record (see ``bag_rows``).

    ``row_sum``, the sum of all counts of the record, is taken before its terms are spread out.
    """
    rows = with_record(ranked_builds(chunk_terms))
    rows = rows.withColumn("row_sum", F.sum("row_sum").over(Window.partitionBy("chunk_ord")))
    return bag_rows(rows, ["chunk_ord", "row_sum"])


def weight(n: int) -> Column:
    """tf times smoothed inverse document frequency, rounded to 6 places."""
    idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    return F.round(F.col("tf") * idf, 6)


def distinctive_terms(
    bags: DataFrame, ws: Workspace, k: int | None = 3, score: str = "residual", least_df: int = 2
) -> DataFrame:
    """``(chunk_ord, term, tf, df, residual, weight, rank)``: the ``k`` most telling terms of each record.

    ``bags`` has one row per record and term. With N the sum of all counts, r
    and c the shares of a record and a term in it, the expected count is
    ``e = N r c`` and the adjusted residual ``(tf - e) / sqrt(e (1 - r) (1 - c))``:
    Pearson's residual divided by its standard deviation under independence
    (null where one record or one term is all there is). ``weight`` is
    ``tf ln((n - df + 0.5) / (df + 0.5) + 1)``. Both are rounded to 6 places
    and computed for every cell; ``score`` says which one ranks, ties go by term
    in code-point order. Terms with fewer than ``least_df`` records are scored
    but not given out. ``k`` None gives every term. Empty bags give no rows.

    Bags of ``latest_bags`` bring the records' margins along; for others they
    are one aggregation and a join more. The terms' margins are one
    pre-aggregated shuffle. They are looked up by a broadcast if they are
    counted to be few, else see ``keyed_lookup``.
    """
    if "row_sum" not in bags.columns:
        heads = bags.groupBy("chunk_ord").agg(F.sum("tf").alias("row_sum"))
        ones = heads.select("chunk_ord", "row_sum", F.lit(RECORD).alias("term"), F.lit(1).cast("long").alias("tf"))
        bags = bags.join(heads, "chunk_ord").select("chunk_ord", "row_sum", "term", F.col("tf").cast("long").alias("tf")).unionByName(ones)
    bags = ws.cut(bags, "bags")
    cols = ws.cut(bags.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("col_sum")), "margins")
    record = F.col("term") == RECORD
    n, total, cells = cols.agg(F.sum(F.when(record, F.col("df"))), F.sum(F.when(~record, F.col("col_sum"))), F.sum("df")).first()
    cols = cols.where((F.col("df") >= least_df) & ~record)
    # the looked-up table must keep its weight column, so it goes in twice
    cells_df = keyed_lookup(bags, cols.withColumn("w", F.col("df")), ["term"], "w", cells or 0, table_rows=cols.count()).drop("w")
    e = F.col("row_sum") * F.col("col_sum") / F.lit(float(total or 1))
    spread = e * (1 - F.col("row_sum") / F.lit(float(total or 1))) * (1 - F.col("col_sum") / F.lit(float(total or 1)))
    residual = F.when(spread > 0, F.round((F.col("tf") - e) / F.sqrt(spread), 6))
    scored = cells_df.select("chunk_ord", "term", "tf", "df", residual.alias("residual"), weight(n or 0).alias("weight"))
    order = Window.partitionBy("chunk_ord").orderBy(F.col(score).desc_nulls_last(), "term")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ws.cut(ranked if k is None else ranked.where(F.col("rank") <= k), "scored")


class TermCounts:
    """Counts ``(term, tf, df)`` of a collection in a folder of their own, kept by signed deltas.

    Terms lie in buckets by their hash, as many as their number asks for.
    ``apply`` takes what records that were added, changed or deleted change in
    the counts, and writes a new version: only buckets that hold a changed term
    are read and written, the others stay where they are. A version is
    published whole (see ``plans.versions``) with the name of its batch; a
    batch that is applied already changes nothing, so it may be sent again.
    """

    #: Terms of a bucket when buckets are laid out, and by how much it may grow until they are laid out anew.
    BUCKET_TERMS, GROWTH, MOST_BUCKETS = 200_000, 8, 4096
    _SCHEMA, _META = "term string, tf long, df long", "records long, terms long, buckets int, batches array<string>, places array<string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def _meta(self, version: int | None = None) -> dict:
        version = self.versions.current() if version is None else version
        if not version:
            return {"records": 0, "terms": 0, "buckets": 0, "batches": [], "places": []}
        return self.spark.read.schema(self._META).parquet(f"{self.versions.folder(version)}/meta").first().asDict()

    def _buckets(self, meta: dict, numbers) -> DataFrame:
        paths = [f"{self.versions.path}/{meta['places'][b]}/counts/bucket={b}" for b in numbers if meta["places"][b]]
        return self.spark.read.schema(self._SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self._SCHEMA)

    def read(self) -> DataFrame:
        """``(term, tf, df)`` of the current version."""
        meta = self._meta()
        return self._buckets(meta, range(meta["buckets"]))

    def records(self) -> int:
        return self._meta()["records"]

    def apply(self, delta: DataFrame, batch: str) -> "TermCounts":
        """``delta``: ``(term, tf, df)``, signed sums, a term once; that of ``RECORD`` is the number of records."""
        base = self.versions.current()
        meta = self._meta(base)
        if batch in meta["batches"]:
            return self
        stage = self.versions.stage()
        ws = Workspace(self.spark, "term-counts")
        try:
            delta = ws.cut(delta.select("term", F.col("tf").cast("long").alias("tf"), F.col("df").cast("long").alias("df")).where("tf <> 0 or df <> 0"), "delta")
            n, records = delta.agg(F.count(F.lit(1)), F.sum(F.when(F.col("term") == RECORD, F.col("df")))).first()
            delta, buckets = delta.where(F.col("term") != RECORD), meta["buckets"]
            anew = not buckets or (meta["terms"] + n) > buckets * self.BUCKET_TERMS * self.GROWTH and buckets < self.MOST_BUCKETS
            if anew:
                buckets = int(min(self.MOST_BUCKETS, max(1, -(-(meta["terms"] + n) // self.BUCKET_TERMS))))
            bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
            touched = sorted(r[0] for r in delta.select(bucket).distinct().collect())  # MOST_BUCKETS at most
            old = self._buckets(meta, range(meta["buckets"]) if anew else touched)
            merged = old.unionByName(delta).groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
            merged = merged.where("df <> 0 or tf <> 0").select("term", "tf", "df", bucket)
            merged.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(f"{stage}/counts")
            schema = f"{self._SCHEMA}, bucket int"
            sizes = dict(self.spark.read.schema(schema).parquet(f"{stage}/counts").groupBy("bucket").count().collect())
            before = 0 if anew else old.count()
            places = [None] * buckets if anew else list(meta["places"])
            for b in range(buckets) if anew else touched:
                places[b] = stage.rpartition("/")[2] if b in sizes else None
            terms = (0 if anew else meta["terms"] - before) + sum(sizes.values())
            row = (meta["records"] + (records or 0), terms, buckets, [*meta["batches"], batch], places)
            self.spark.createDataFrame([row], self._META).coalesce(1).write.parquet(f"{stage}/meta")
            self.versions.publish(stage, base)
        except BaseException:
            delete_path(self.spark, stage)
            raise
        finally:
            ws.close()
        return self


def term_delta(signed_bags: DataFrame) -> DataFrame:
    """``(term, tf, df)`` for ``TermCounts.apply`` from ``(chunk_ord, term, tf, sign)``, one row per record, term and sign.

    A record's terms have sign 1 as it holds them now, and -1 as it held them before.
    """
    sums = [F.sum(F.col("tf") * F.col("sign")).alias("tf"), F.sum("sign").cast("long").alias("df")]
    heads = signed_bags.groupBy("chunk_ord", "sign").agg(F.lit(1).alias("one")).select(F.lit(RECORD).alias("term"), F.lit(0).cast("long").alias("tf"), "sign")
    return signed_bags.select("term", "tf", "sign").unionByName(heads).groupBy("term").agg(*sums)


def marked_terms(counts: DataFrame, n: int, rare: int = 2, common: float = 0.4) -> DataFrame:
    """``(term, tf, df, mark)``: ``rare`` at most that many records, ``common`` more than that share of them, else null."""
    mark = F.when(F.col("df") <= rare, "rare").when(F.col("df") > common * n, "common")
    return counts.select("term", "tf", "df", mark.alias("mark"))


def counts_by_builds(chunk_terms: DataFrame, ws: Workspace) -> TermCounts:
    """Counts after the newest build, taken as an increment to the state that earlier builds left.

    The first batch holds the bags that were current before the newest build.
    The second adds the new bags of the chunks in that build and takes away what
    they held before; the store is opened anew for it. Both are summed by term
    in one pass, as what a term has before and what the newest build changes.
    """
    spark = chunk_terms.sparkSession
    newest = chunk_terms.where("chunk_ord is not null").agg(F.max("build_no")).first()[0]
    rows = ranked_builds(chunk_terms, 2)
    is_new = F.coalesce(F.col("build_no") == F.lit(newest), F.lit(False))
    # of a chunk in the newest build both its bags matter, of another only its latest
    rows = rows.withColumn("is_new", is_new).withColumn("in_new", F.max("is_new").over(Window.partitionBy("chunk_ord")))
    rows = rows.where(F.col("in_new") | (F.col("back") == 1))
    bags = bag_rows(with_record(rows).drop("row_sum"), ["chunk_ord", "in_new", "is_new"])
    sign = F.when(F.col("is_new"), 1).otherwise(-1)
    was, moved = ~F.col("is_new"), F.col("in_new")
    sums = {"tf0": F.when(was, F.col("tf")), "df0": F.when(was, 1), "tf1": F.when(moved, F.col("tf") * sign), "df1": F.when(moved, sign)}
    terms = ws.cut(bags.groupBy("term").agg(*(F.coalesce(F.sum(v), F.lit(0)).cast("long").alias(k) for k, v in sums.items())), "sums")
    path = ws.at("counts")
    TermCounts(spark, path).apply(terms.select("term", F.col("tf0").alias("tf"), F.col("df0").alias("df")), "before")
    TermCounts(spark, path).apply(terms.select("term", F.col("tf1").alias("tf"), F.col("df1").alias("df")), f"build {newest}")
    return TermCounts(spark, path)
