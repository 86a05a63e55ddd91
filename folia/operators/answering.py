"""Retrieval as whole plans: candidates for questions with what they report, and representative chunks with caches and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folia.functions import text as T

from . import retrieval

#: Selections: the chunks chosen for a document under a budget, by run, collection and strategy.
SELECTIONS = "run_id string, collection string, strategy_name string, doc_id string, max_chunks int, pos int, chunk_index int"


def fallback_budget(top_k: int) -> int:
    """Candidates that are reranked where no coverage selection is possible."""
    return min(80, max(4 * top_k, top_k + 12))


def representative_query(filename: Column) -> Column:
    """The question that stands for a document as a whole."""
    return F.concat(F.lit("Find representative explanatory body chunks for a document-wide summary. Prefer claims, results, risks and conclusions to contents, appendices, titles, captions and bare figures. Document: "), filename)


def retrieved(vector: DataFrame, keyword: DataFrame, texts: DataFrame, queries: DataFrame, top_k: int = retrieval.FINAL_K) -> tuple[DataFrame, DataFrame]:
    """The answer candidates of each question, and a report row per question.

    ``vector``, ``keyword``: ranked lists (query_id, doc, rank); ``texts``: doc, text,
    page; ``queries``: query_id, text. The lists are fused and reranked. The report
    counts candidates at each stage, boilerplate among the fused and the final ones,
    and tells whether the page that the question names was found (null if it names none).
    """
    fused = retrieval.rrf(vector, keyword)
    final = retrieval.qa_rerank(fused, texts, queries, min(top_k, retrieval.FINAL_K))
    said = fused.join(texts.select("doc", "page", T.boilerplate(T.coverage_text(F.col("text"))).alias("noise")), "doc")
    wanted = queries.select("query_id", T.expected_page(F.col("text")).alias("wanted"))
    pool = said.join(wanted, "query_id").groupBy("query_id").agg(F.count("*").alias("fused"), F.count_if("noise").alias("boilerplate_fused"), F.max(F.col("page") == F.col("wanted")).alias("page_hit_fused"))
    best = final.join(texts.select("doc", "page"), "doc").join(wanted, "query_id").groupBy("query_id").agg(F.count("*").alias("returned"), F.count_if("is_boilerplate").alias("boilerplate_returned"), F.max(F.col("page") == F.col("wanted")).alias("page_hit_returned"))
    counted = [x.groupBy("query_id").agg(F.count("*").alias(n)) for x, n in ((vector, "vector_candidates"), (keyword, "keyword_candidates"))]
    report = queries.select("query_id")
    for part in (*counted, pool, best):
        report = report.join(part, "query_id", "left")
    return final, report.fillna(0)


def previews(rows: DataFrame, limit: int = 5, characters: int = 180) -> DataFrame:
    """The first ``limit`` candidates of each question as a log shows them: names, rounded scores and the text's beginning."""
    scores = [F.round(c, 6).alias(c) for c in ("rrf_score", "qa_rank_score") if c in rows.columns]
    return rows.filter(F.col("qa_rank") <= limit).select("query_id", "qa_rank", "doc", *scores, "is_boilerplate", F.substring(F.coalesce("text", F.lit("")), 1, characters).alias("preview"))


def from_parallel(results: DataFrame) -> DataFrame:
    """A row per answer of a store that returns parallel lists (query_id, ids, metadatas, documents, distances); short lists leave nulls.

    A record's id fills in where its metadata has none; the distance becomes a score.
    """
    zipped = F.arrays_zip("ids", "metadatas", "documents", "distances")
    rows = results.select("query_id", F.posexplode(F.filter(zipped, lambda x: x["ids"].isNotNull())).alias("pos", "x"))
    record = T.truthy(F.get_json_object("x.metadatas", "$.vector_record_id"), F.col("x.ids"))
    return rows.select("query_id", "pos", record.alias("vector_record_id"), F.coalesce("x.documents", F.lit("")).alias("text"), F.when(F.col("x.distances").isNotNull(), retrieval.distance_score(F.col("x.distances"))).alias("score"))


def selections(spark: SparkSession, path: str) -> DataFrame:
    """The stored selections at ``path``; none before the first."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], SELECTIONS)
    return spark.read.schema(SELECTIONS).parquet(path)


def restored(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that a stored selection (doc_id, pos, chunk_index) names, in its order; names that no candidate has are passed over."""
    met = chosen.select("doc_id", "pos", "chunk_index").join(candidates, ["doc_id", "chunk_index"])
    return met.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))).drop("pos")


def representative(scored: DataFrame, top_k: int, reranked: DataFrame | None = None, stored: DataFrame | None = None) -> DataFrame:
    """doc_id, page_num, chunk_index, place, backend: the chunks that stand for each document.

    ``scored``: chunks as ``retrieval.with_coverage`` gives them. A document whose
    selection is in ``stored`` gets that one back; others with chunks are selected by
    coverage; documents that ``reranked`` (doc_id, page_num, chunk_index, rank) alone
    knows get its first ``top_k``. Only documents without a stored selection are scored through.
    """
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("page_num", "chunk_index"))
    columns = ["doc_id", "page_num", "chunk_index", "place", "backend"]
    parts, open_ = [], scored
    if stored is not None:
        back = restored(stored, scored.select("doc_id", "page_num", "chunk_index"))
        parts.append(back.withColumn("backend", F.lit("coverage_selection_cache")).select(columns))
        open_ = scored.join(back.select("doc_id").distinct(), "doc_id", "left_anti")
    chosen = retrieval.select_coverage(open_, retrieval.coverage_budget(top_k))
    parts.append(chosen.withColumns({"place": place, "backend": F.lit("coverage_selection")}).select(columns))
    if reranked is not None:
        rest = reranked.join(scored.select("doc_id").distinct(), "doc_id", "left_anti").filter(F.col("rank") <= top_k)
        parts.append(rest.withColumns({"place": F.col("rank"), "backend": F.lit("rerank_candidates")}).select(columns))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keep_selections(chosen: DataFrame, path: str, run_id: str, collection: str, strategy: str, max_chunks: int) -> None:
    """Append the selections of ``representative`` that weren't stored yet."""
    fresh = chosen.filter("backend = 'coverage_selection'")
    fixed = {"run_id": run_id, "collection": collection, "strategy_name": strategy}
    rows = fresh.select(*(F.lit(v).alias(k) for k, v in fixed.items()), "doc_id", F.lit(max_chunks).alias("max_chunks"), F.col("place").cast("int").alias("pos"), "chunk_index")
    rows.write.mode("append").parquet(path)
