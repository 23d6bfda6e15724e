"""Tables and SQL fragments that the plans share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minutario.functions.text import TERM_STOP_WORDS
from minutario.versions import latest

DECISION_COLUMNS = ["meeting_id", "series_id", "source_sentence_id", "sentence_text", "evidence_da_count", "evidence_text", "status", "decision_object", "decision_content", "annotator", "machine_flags"]
CANDIDATE_COLUMNS = ["series_id", "earlier_decision_id", "later_decision_id", "earlier_text", "later_text", "blocker_score", "gm_relation", "gv_relation", "ka_relation", "gm_direction_ok", "final_relation", "final_direction_ok"]
REVIEW_COLUMNS = ["series_id", "stratum", "pregunta", "respuesta_referencia", "respuesta_c2", "abstained", "objetos_de_la_base", "pista_automatica", "etapa_humana"]
ADJUDICATION_COLUMNS = ["meeting_id", "series_id", "gm_status", "gv_status", "ka_status", "acuerdo", "final_status"]
CHUNK_COLUMNS = ["meeting_id", "series_id", "char_start", "char_end", "text"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held(spark: SparkSession, folder: str, name: str, key: str, columns: list[str]) -> DataFrame:
    return latest(table(spark, folder, name).select(key, *columns, "ingested_at"), key, [key, *columns])


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    return held(spark, folder, "decisions", "decision_id", DECISION_COLUMNS)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return held(spark, folder, "candidates", "pair_id", CANDIDATE_COLUMNS)


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    return held(spark, folder, "stage_reviews", "pregunta_id", REVIEW_COLUMNS)


def adjudications(spark: SparkSession, folder: str) -> DataFrame:
    return held(spark, folder, "adjudications", "decision_id", ADJUDICATION_COLUMNS)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return held(spark, folder, "chunks", "chunk_id", CHUNK_COLUMNS)


def rounded(c: Column | str, places: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, places)


def held_sql(name: str, key: str, columns: list[str]) -> str:
    order = ", ".join(f"{c} desc nulls last" for c in ["ingested_at", *columns])
    return f"(select {key}, {', '.join(columns)} from {name} where {key} is not null qualify row_number() over (partition by {key} order by {order}) = 1)"


DECISIONS = held_sql("decisions", "decision_id", DECISION_COLUMNS)
CANDIDATES = held_sql("candidates", "pair_id", CANDIDATE_COLUMNS)
REVIEWS = held_sql("stage_reviews", "pregunta_id", REVIEW_COLUMNS)
ADJUDICATIONS = held_sql("adjudications", "decision_id", ADJUDICATION_COLUMNS)
CHUNKS = held_sql("chunks", "chunk_id", CHUNK_COLUMNS)

STOP = ", ".join(f"'{w}'" for w in TERM_STOP_WORDS)


def terms_sql(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[a-z]+')), lambda x: length(x) >= 3 and x not in ({STOP}))"


def label_sql(cell: str) -> str:
    bare = rf"regexp_replace(strip_accents(lower({cell})), '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"
    return rf"regexp_replace(regexp_replace({bare}, '\s*\.$', ''), '[\s_-]+', '_', 'g')"
