"""Nearest neighbours, text vectors and hybrid case search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    IDF, CountVectorizerModel, ElementwiseProduct, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer,
    StopWordsRemover,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docketry.functions import text as X
from docketry.kernels import SIEVE_BITS, TermTable, codes_and_words, nearest_task, term_counts, term_sieve
from docketry.operators.scaling import broadcast_if_small, top_per_key
from docketry.session import cut_lineage, delete_folder, scratch_path, small_batches

# Queries and rows that one group compares; larger tables make more groups. When these are more than
# GROUPS for each core, blocks of queries grow up to MOST_QUERIES, so that rows are copied to fewer of them.
QUERY_BLOCK, ROW_BLOCK = 4096, 65_536
MOST_QUERIES, GROUPS = 32_768, 4
# Tasks for each core that count terms.
TASKS_PER_CORE = 3
# Bytes of text, and texts, that an encoder gets at once.
ENCODED_BYTES, ENCODED_ROWS = 1_000_000, 1024


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact ``k`` nearest rows by squared distance: ``(query_id, id, distance)``.

    Both inputs are ``(id, vector)`` with ids of one type; null vectors are left
    out. Queries and rows are dealt into blocks by hash, every block of queries
    meets every block of rows in a task, and a group keeps ``k`` rows per query.
    """
    whole = lambda df: df.select(F.lit(0).alias("space"), "id", "vector")
    return nearest_within(whole(queries), whole(vectors), k)


def block_pairs(queries: DataFrame, rows: DataFrame, query_block: int, row_block: int, most: int = 0) -> DataFrame:
    """Both tables in one, dealt so that every query meets every row of its ``space`` in one group.

    Blocks of queries may grow up to ``most``; a row is copied to each block of its space.

    The tables have equal columns with ``space`` (an integer) and ``id`` among them.
    Groups are ``(space, a, b)``: block ``a`` of a space's queries and block ``b`` of
    its rows, by hash of the id. Queries, with ``is_row`` 0, come first in a group.
    """
    columns = [c for c in queries.columns if c != "space"]
    sides = []
    for df, name, size in ((queries, "a", query_block), (rows, "b", row_block)):
        df = cut_lineage(df.select("space", *columns))
        if name == "a" and most > size:
            size = max(size, min(most, df.count() // (GROUPS * df.sparkSession.sparkContext.defaultParallelism)))
        parts = df.groupBy("space").agg(F.ceil(F.count("*") / F.lit(float(size))).cast("int").alias(f"n_{name}"))
        sides.append((df, parts))
    (asked, of_asked), (rows, of_rows) = sides
    # A row per space that both sides have; spaces are one, or the cells of an index.
    sizes = broadcast_if_small(of_asked.join(of_rows, "space"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["space", "a", "b", "is_row"]
    asked = asked.join(sizes, "space").withColumn("a", part("n_a")).withColumn("b", every("n_b")).withColumn("is_row", F.lit(0))
    rows = rows.join(sizes, "space").withColumn("b", part("n_b")).withColumn("a", every("n_a")).withColumn("is_row", F.lit(1))
    both = asked.select(*keys, *columns).unionByName(rows.select(*keys, *columns))
    return both.repartition("space", "a", "b").sortWithinPartitions(*keys)


def nearest_within(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``nearest`` for rows of equal ``space`` (an integer); a query may look into several spaces.

    With a column ``cells``, a list of a query's cells and a row's own one, a query
    meets only the rows of its cells.
    """
    more = ["cells"] if "cells" in queries.columns else []
    # Tasks compute with doubles; floats travel as they are when both sides hold them.
    short = all(df.schema["vector"].dataType.simpleString() == "array<float>" for df in (queries, vectors))
    ready = lambda df: df.where(F.col("vector").isNotNull()).select(
        "space", "id", F.col("vector").cast("array<float>" if short else "array<double>").alias("vector"), *more)
    placed = block_pairs(ready(queries), ready(vectors), QUERY_BLOCK, ROW_BLOCK, MOST_QUERIES)
    kind = queries.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("distance", T.DoubleType())])
    found = placed.mapInArrow(nearest_task(k, to_arrow_schema(schema)), schema)
    return top_per_key(found, ["query_id"], [F.asc("distance"), F.asc("id")], k)


def build_cells(vectors: DataFrame, nlist: int | None = None, seed: int = 42):
    """Assign vectors to k-means cells trained on all rows; returns the table with ``cell`` and the centroids."""
    points = cut_lineage(vectors.withColumn("_point", array_to_vector(F.transform("vector", lambda x: x.cast("double")))))
    n = points.count()
    nlist = nlist or max(1, min(4096, int(math.sqrt(n))))
    model = KMeans(k=nlist, seed=seed, featuresCol="_point", predictionCol="cell", maxIter=10).fit(points)
    cells = model.transform(points).drop("_point")
    return cells, np.array([c for c in model.clusterCenters()])


def probed(queries: DataFrame, cells: DataFrame, centroids: np.ndarray, nprobe: int) -> tuple[DataFrame, DataFrame]:
    """Queries and rows by ``space``, a group of cells of about ``ROW_BLOCK`` rows, with the ``cells`` they belong to.

    A query goes once to each group that holds one of its ``nprobe`` nearest cells,
    with those cells; a row, which has one ``cell``, goes to its own group.
    """
    groups = max(1, math.ceil(cells.count() / ROW_BLOCK))
    rest = [c for c in cells.columns if c not in ("id", "cell")]
    rows = cells.select((F.col("cell") % groups).alias("space"), "id", *rest, F.array("cell").alias("cells"))
    asked = queries.where(F.col("vector").isNotNull()).select("id", "vector")
    schema = T.StructType([T.StructField("space", T.IntegerType()), *asked.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)
    squares = (centroids ** 2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), -1)
                d = (x ** 2).sum(axis=1)[:, None] + squares[None, :] - 2.0 * x @ centroids.T
                near = np.zeros(d.shape, bool)
                np.put_along_axis(near, np.argsort(d, axis=1, kind="stable")[:, :nprobe], True, axis=1)
                for group in range(groups):
                    row, cell = np.nonzero(near[:, group::groups])
                    own, sizes = np.unique(row, return_counts=True)
                    lists = pa.ListArray.from_arrays(
                        pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(cell * groups + group, pa.int32()))
                    take = pa.array(own)
                    columns = [pa.array(np.full(len(own), group), pa.int32()), part.column(0).take(take), part.column(1).take(take), lists]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return asked.mapInArrow(run, schema), rows


def approximate_nearest(queries: DataFrame, vectors: DataFrame, k: int, nlist: int | None = None,
                        nprobe: int | None = None, seed: int = 42) -> DataFrame:
    """Nearest rows among the cells closest to each query."""
    cells, centroids = build_cells(vectors, nlist, seed)
    asked, rows = probed(queries, cells.select("id", "vector", "cell"), centroids, nprobe or min(64, len(centroids)))
    return nearest_within(asked, rows, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found."""
    pairs = exact.select("query_id", "id").join(
        found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left"
    )
    return pairs.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("recall"))


# --- text vectors -----------------------------------------------------------


def word_hash(word: Column, seed: int) -> Column:
    return F.xxhash64(word, F.lit(seed))


def common_terms(lists: DataFrame, column: str, size: int, ngrams: int = 1, min_df: float = 1.0, max_df: float | None = None,
                 word_hash: Callable[[Column, int], Column] = word_hash, seed: int = 0) -> tuple[int, list[tuple[str, int]]]:
    """Number of rows, and the ``size`` most frequent terms of 1 to ``ngrams`` words with the rows that hold them.

    ``column`` lists the words of a row. Terms must be in ``min_df`` to ``max_df`` rows
    (a share below 1); equal totals go by hash. Terms are counted by a hash that is
    made of their words' hashes, and no term leaves a task as text. A sieve counts all
    terms by buckets of their hash; a bucket counts at least as often as each of its
    terms, so only terms of buckets at or above a floor are told apart, and they hold
    the wanted ones when the last of these reaches the floor. Else the floor is lowered.
    Where words share a hash, another seed is taken. The tables of hashes are deleted at the end.
    """
    with small_batches(lists.sparkSession):
        return _common_terms(lists, column, size, ngrams, min_df, max_df, word_hash, seed)


def _common_terms(lists: DataFrame, column: str, size: int, ngrams: int, min_df: float, max_df: float | None,
                  word_hash: Callable[[Column, int], Column], seed: int) -> tuple[int, list[tuple[str, int]]]:
    spark, paths = lists.sparkSession, [scratch_path(lists.sparkSession, name) for name in ("codes", "sieve")]
    hashed = lists.select(F.col(column).alias("words"), F.transform(column, lambda w: word_hash(w, seed)).alias("codes"))
    hashed = hashed.mapInArrow(codes_and_words, "codes array<long>, fresh array<struct<h: long, word: string>>")
    hashed.write.parquet(paths[0])  # read by each pass
    both = spark.read.schema(hashed.schema).parquet(paths[0])
    # A task sends its counts once, so what the passes shuffle goes with the number of tasks.
    codes = both.select("codes").coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    n = codes.count()
    least, most = (limit if limit is None or limit >= 1 else limit * n for limit in (min_df, max_df))
    sieved = codes.mapInArrow(partial(term_sieve, ngrams=ngrams), "bucket int, total long").groupBy("bucket").agg(F.sum("total").alias("total"))
    sieved.write.parquet(paths[1])
    sieved = spark.read.schema(sieved.schema).parquet(paths[1])
    first = sieved.orderBy(F.desc("total")).limit(4 * size).collect()  # a small multiple of ``size``
    floor = first[-1]["total"] if len(first) == 4 * size else 1
    words = [f"w{i}" for i in range(ngrams)]
    schema = "h long, " + "".join(f"{w} long, " for w in words) + "total long, rows long"
    while True:
        marks = np.zeros(1 << SIEVE_BITS, bool)
        marks[sieved.where(F.col("total") >= floor).select("bucket").toArrow()["bucket"].to_numpy()] = True  # a row per bucket
        exact = codes.mapInArrow(partial(term_counts, wanted=np.packbits(marks), ngrams=ngrams), schema).groupBy("h", *words).agg(
            F.sum("total").alias("total"), F.sum("rows").alias("rows")).where(F.col("rows") >= least)
        if most is not None:
            exact = exact.where(F.col("rows") <= most)
        found = exact.orderBy(F.desc("total"), "h", *words).limit(size).collect()  # rows are ``size`` at most
        if floor <= 1 or (len(found) == size and found[-1]["total"] >= floor):
            break
        floor = found[-1]["total"] if len(found) == size else floor // 8
    used = sorted({r[w] for r in found for w in words if r[w] is not None})
    named = []
    if used:
        asked = spark.createDataFrame([(h,) for h in used], "h long")
        each = both.select(F.explode("fresh").alias("f")).select("f.h", "f.word")
        named = each.join(F.broadcast(asked), "h").groupBy("h").agg(F.min("word").alias("word"), F.max("word").alias("last")).collect()
    for path in paths:  # as large as the texts
        delete_folder(spark, path)
    if any(r["word"] != r["last"] for r in named):
        return _common_terms(lists, column, size, ngrams, min_df, max_df, word_hash, seed + 1)
    text = {r["h"]: r["word"] for r in named}
    return n, [(" ".join(text[r[w]] for w in words if r[w] is not None), r["rows"]) for r in found]


def fit_tfidf(df: DataFrame, text: str, output: str, max_features: int, ngrams: int = 1, min_df: float = 1.0,
              max_df: float | None = None) -> PipelineModel:
    """Term weights with the smoothing ln((1+n)/(1+df)) + 1 and unit length.

    The vocabulary comes from all rows. All steps persist in one pipeline model.
    """
    p = f"_{output}"
    stages = [
        RegexTokenizer(inputCol=text, outputCol=f"{p}_raw", pattern=r"(?U)\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol=f"{p}_raw", outputCol=f"{p}_1"),
    ]
    stages += [NGram(n=n, inputCol=f"{p}_1", outputCol=f"{p}_{n}") for n in range(2, ngrams + 1)]
    parts = ", ".join(f"{p}_{n}" for n in range(1, ngrams + 1))
    stages.append(SQLTransformer(statement=f"SELECT *, concat({parts}) AS {p}_grams FROM __THIS__"))
    words = PipelineModel(stages[:2]).transform(df.select(text)).select(f"{p}_1")
    n, terms = common_terms(words, f"{p}_1", max_features, ngrams, min_df, max_df)
    counter = CountVectorizerModel.from_vocabulary([term for term, _ in terms], f"{p}_grams", f"{p}_tf")
    weights = [math.log((n + 1) / (rows + 1)) + 1.0 for _, rows in terms]
    scale = ElementwiseProduct(scalingVec=Vectors.dense(weights), inputCol=f"{p}_tf", outputCol=f"{p}_w")
    return PipelineModel([*stages, counter, scale, Normalizer(p=2.0, inputCol=f"{p}_w", outputCol=output)])


def with_tfidf(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Apply a term-weight model and drop its working columns."""
    out = model.transform(df)
    keep = [*df.columns, model.stages[-1].getOutputCol()]
    return out.select(*keep)


def with_term_counts(model: PipelineModel, df: DataFrame, name: str = "_e") -> DataFrame:
    """What ``with_tfidf`` weighs, as a struct of the arrays ``index`` and ``count``: counts of the vocabulary's terms.

    Words are looked up by their text, and terms by the numbers of their words, so no term is spelled out.
    """
    sent = df.sparkSession.sparkContext.broadcast(vocabulary(model))
    held = []

    @F.arrow_udf("struct<index: array<int>, count: array<int>>")
    def listed(words: pa.Array) -> pa.Array:
        if not held:  # once per worker and function
            held.append(TermTable(sent.value))
        return held[0].listed(words)

    words = model.stages[1]  # the tokens without stop words
    out = PipelineModel(model.stages[:2]).transform(df)
    return out.select(*df.columns, listed(words.getOutputCol()).alias(name))


def term_weights(model: PipelineModel) -> np.ndarray:
    return next(s for s in model.stages if isinstance(s, ElementwiseProduct)).getScalingVec().toArray()


def vocabulary(model: PipelineModel) -> list[str]:
    return next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))


def sparse_pairs(vector: str | Column) -> Column:
    """Non-zero entries as ``array<struct<index,value>>``."""
    inner = F.unwrap_udt(F.col(vector) if isinstance(vector, str) else vector)
    pair = lambda i, v: F.struct(i.alias("index"), v.alias("value"))
    sparse = F.zip_with(inner["indices"], inner["values"], pair)
    every = F.when(inner["type"] == 0, sparse).otherwise(F.transform(inner["values"], lambda v, i: pair(i, v)))
    return F.filter(every, lambda e: e["value"] != 0)


def keyword_index(df: DataFrame, key: str, text: str, max_features: int = 1000, ngrams: int = 2) -> DataFrame:
    """Long rows ``(key, term, weight)`` over unigrams and bigrams."""
    model = fit_tfidf(df, text, "weights", max_features, ngrams)
    # The vocabulary is limited to ``max_features`` terms, so it fits a literal array.
    terms = F.array(*[F.lit(t) for t in vocabulary(model)])
    rows = with_tfidf(model, df).select(key, F.explode(sparse_pairs("weights")).alias("e"))
    return rows.select(key, F.get(terms, F.col("e.index")).alias("term"), F.col("e.value").alias("weight"))


def hashed_embeddings(df: DataFrame, text: str, output: str = "vector", dims: int = 256) -> DataFrame:
    """Unit-length vectors from hashed, weighted terms."""
    tokens = RegexTokenizer(inputCol=text, outputCol="_raw", pattern=r"(?U)\b\w\w+\b", gaps=False)
    steps = PipelineModel([tokens, StopWordsRemover(inputCol="_raw", outputCol="_tokens"),
                           HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims)])
    counted = steps.transform(df)
    idf = IDF(inputCol="_tf", outputCol="_w").fit(counted)
    out = Normalizer(p=2.0, inputCol="_w", outputCol="_unit").transform(idf.transform(counted))
    return out.withColumn(output, vector_to_array("_unit", "float32")).select(*df.columns, output)


def encoded(df: DataFrame, text: str, encoder: Callable[[Sequence[str]], np.ndarray], output: str = "vector") -> DataFrame:
    """Vectors from a caller's batch encoder, scaled to unit length.

    ``encoder`` maps a list of texts to a matrix. It is called for texts of about
    ``ENCODED_BYTES`` in all, or for one longer text, so a task holds no more at once
    than that and the Arrow batch it reads.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.FloatType()))])
    arrow, at = to_arrow_schema(schema), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, min(lo + ENCODED_ROWS, int(np.searchsorted(ends, before + ENCODED_BYTES, side="right"))))
                part = batch.slice(lo, hi - lo)
                matrix = np.asarray(encoder([t or "" for t in part.column(at).to_pylist()]), np.float32)
                length = np.linalg.norm(matrix, axis=1, keepdims=True)
                unit = matrix / np.where(length == 0, 1, length)
                starts = pa.array(np.arange(len(unit) + 1) * unit.shape[1], pa.int32())
                vectors = pa.ListArray.from_arrays(starts, pa.array(unit.ravel(), pa.float32()))
                columns = [c.cast(t) for c, t in zip([*part.columns, vectors], arrow.types)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                lo = hi

    return df.mapInArrow(run, schema)


# --- hybrid search ----------------------------------------------------------

REQUIRED_FIELDS = ("text_excerpt", "tech_keywords_found", "tech_relevance_score")
SCORE_WEIGHTS = {"semantic": 0.3, "keyword": 0.2, "tech": 0.2, "citation": 0.15, "entity": 0.1, "time": 0.05}


def hybrid_search(queries: DataFrame, cases: DataFrame, vectors: DataFrame, importance: DataFrame, k: int = 5,
                  pool: int = 20, search: Callable[[DataFrame, DataFrame, int], DataFrame] = nearest) -> DataFrame:
    """The ``k`` nearest distinct cases per query, ranked by a weighted score.

    ``queries`` is ``(id, text, vector)``, ``vectors`` ``(id, vector)``, ``cases``
    has the same ``id``, ``importance`` is ``(id, score)``. Rows lacking a field or a
    date are dropped, then each normalised name keeps its nearest row. The search
    begins with ``pool`` times ``k`` candidates; queries that these leave with fewer
    than ``k`` names search four times as many, until they have ``k`` or all rows
    were candidates. ``search`` finds exact neighbours.
    """
    extra = [c for c in ("tech_relevance_category",) if c in cases.columns]
    columns = cases.select("id", "case_name", "date_filed", "court", *REQUIRED_FIELDS, *extra)
    usable = cut_lineage(columns.dropna(subset=[*REQUIRED_FIELDS, "date_filed", "case_name"]).withColumn(
        "_name", X.normalised_name("case_name")))
    vectors = cut_lineage(vectors.select("id", "vector").where(F.col("vector").isNotNull()))
    near = [F.asc("distance"), F.asc("id")]
    left, size, rows, firsts = queries.select("id", "vector"), k * pool, vectors.count(), None
    while True:
        named = usable.join(broadcast_if_small(search(left, vectors, size)), "id")
        some = cut_lineage(top_per_key(top_per_key(named, ["query_id", "_name"], near), ["query_id"], near, k))
        filled = some.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        whole = size >= rows
        done = some if whole else some.join(filled.select("query_id"), "query_id", "left_semi")
        firsts = done if firsts is None else firsts.unionByName(done)
        if whole:
            break
        left = cut_lineage(left.join(filled, F.col("id") == F.col("query_id"), "left_anti"))
        if not left.limit(1).count():
            break
        size *= 4
    texts = queries.select(F.col("id").alias("query_id"), F.col("text").alias("_query"))
    scored = firsts.join(texts, "query_id").join(importance.select("id", F.col("score").alias("_imp")), "id", "left")
    q_words = X.word_set(F.col("_query"))
    c_words = X.word_set(F.concat_ws(" ", "case_name", "text_excerpt", "tech_keywords_found"))
    q_ent, c_ent = X.entities("_query"), X.entities("text_excerpt")
    shared = sum((F.size(F.array_intersect(q_ent[t], c_ent[t])) for t in X.ENTITY_PATTERNS), F.lit(0))
    named_in_query = sum((F.size(q_ent[t]) for t in X.ENTITY_PATTERNS), F.lit(0))
    parts = {
        "semantic": 1.0 - F.col("distance"),
        "keyword": F.coalesce(F.try_divide(F.size(F.array_intersect(q_words, c_words)).cast("double"), F.size(q_words).cast("double")), F.lit(0.0)),
        "tech": F.col("tech_relevance_score"),
        "citation": F.coalesce("_imp", F.lit(0.0)),
        "entity": shared.cast("double") / F.greatest(F.lit(1), named_in_query).cast("double"),
        "time": X.date_relevance("date_filed"),
    }
    out = scored.withColumns(parts | {"matching_keywords": F.sort_array(F.array_intersect(q_words, c_words)), "entities": c_ent})
    total = sum((F.lit(w) * F.col(name) for name, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    out = out.withColumns({"score": total, "excerpt": F.substring("text_excerpt", 1, 300)})
    # At most k rows per query reach this window.
    ranked = top_per_key(out, ["query_id"], [F.desc("score"), F.asc("id")], k, rank="rank")
    return ranked.select("query_id", "rank", "id", "case_name", "date_filed", "court", *extra, "excerpt",
                         F.col("tech_keywords_found").alias("tech_keywords"), "score", "entities", "matching_keywords", *parts)
