"""Criteria text blocks to typed items (B1-B4, B17-B19, F5). Everything but B17 is narrow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialweave.functions.text import WS, WS_INLINE, is_blank, let, strip, text_lines
from trialweave.operators.ordering import row_index

# Section header and bullet formats.
_HEADER = f"(?iu)^[{WS_INLINE}]*%s[{WS_INLINE}]+criteria"
INCLUSION_HEADER = _HEADER % "inclusion"
EXCLUSION_HEADER = _HEADER % "exclusion"
SECTION_BREAK = f"(?iu)\n(?=[{WS_INLINE}]*(?:inclusion|exclusion)[{WS_INLINE}]+criteria)"
BULLET = f"(?s)^[*-][{WS}]+(.*)$"


def header_type(line: Column) -> Column:
    """inclusion / exclusion when the line opens a section, else null."""
    return F.when(line.rlike(INCLUSION_HEADER), "inclusion").when(line.rlike(EXCLUSION_HEADER), "exclusion")


def bullet_text(stripped: Column) -> Column:
    """Text behind a `*` or `-` marker; '' when the line is no bullet or the bullet is empty."""
    return strip(F.regexp_extract(stripped, BULLET, 1))


def split_lines(studies: DataFrame) -> DataFrame:
    """B1: one row per non-blank line, stripped; a null cell gives none."""
    return (
        studies.select(
            "study_row", "StudyNCTid", F.posexplode(text_lines(F.col("EligibilityCriteria"))).alias("line_no", "raw")
        )
        .select("study_row", "StudyNCTid", "line_no", strip(F.col("raw")).alias("line"))
        .where("line <> ''")
    )


def _sections(block: Column) -> Column:
    """Cut the block before each header line, so that a section carries its own state."""
    return F.split(block, SECTION_BREAK, -1)


def tag_sections(studies: DataFrame) -> DataFrame:
    """B2: every non-blank line with the state set by the last header at or above it.

    The state is null before the first header. Cutting at headers needs no running state
    over lines and so no shuffle by study.
    """

    def tagged(section: Column) -> Column:
        kind = header_type(section)
        return let(
            kind,
            lambda k: F.transform(
                text_lines(section),
                lambda raw, i: F.struct(
                    strip(raw).alias("line"),
                    ((i == 0) & k.isNotNull()).alias("is_header"),
                    k.alias("criteria_type"),
                ),
            ),
        )

    per_line = F.flatten(F.transform(_sections(F.col("EligibilityCriteria")), tagged))
    return (
        studies.select("study_row", "StudyNCTid", F.posexplode(per_line).alias("line_no", "z"))
        .select("study_row", "StudyNCTid", "line_no", "z.*")
        .where("line <> ''")
    )


def extract_bullets(tagged: DataFrame) -> DataFrame:
    """The bullet texts of tagged lines; other lines and empty bullets drop out."""
    return (
        tagged.where("criteria_type IS NOT NULL AND NOT is_header")
        .withColumn("text", bullet_text(F.col("line")))
        .where("text <> ''")
        .drop("line", "is_header")
    )


def explode_criteria(studies: DataFrame) -> DataFrame:
    """Studies -> (study_row, item_no, studyNCTid, criteria_type, text), one narrow stage."""

    def items(section: Column) -> Column:
        bullets = F.transform(text_lines(section), lambda raw, i: F.when(i > 0, bullet_text(strip(raw))))
        texts = F.filter(bullets, lambda t: t != "")
        return let(
            header_type(section),
            lambda kind: F.transform(texts, lambda t: F.struct(kind.alias("criteria_type"), t.alias("text"))),
        )

    headed = F.filter(_sections(F.col("EligibilityCriteria")), lambda s: header_type(s).isNotNull())
    return studies.select(
        "study_row",
        F.col("StudyNCTid").alias("studyNCTid"),
        F.posexplode(F.flatten(F.transform(headed, items))).alias("item_no", "z"),
    ).select("study_row", "item_no", "studyNCTid", "z.criteria_type", "z.text")


def with_sentence_id(df: DataFrame, *order_by: str) -> DataFrame:
    """0-based index of each row in the given unique order."""
    return row_index(df, *order_by, out="sentence_id")


def with_default_columns(df: DataFrame) -> DataFrame:
    """`studyNCTid` and `criteria_type` become "unknown" where the column is absent."""
    for name in ("studyNCTid", "criteria_type"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("unknown"))
    return df


def normalize_text(df: DataFrame, column: str = "text") -> DataFrame:
    """The column as a string, null as ''. The row stays."""
    return df.withColumn(column, F.coalesce(F.col(column).cast(T.StringType()), F.lit("")))


def head_sentences(df: DataFrame, n: int | None) -> DataFrame:
    """the first n rows by sentence id; null or 0 keeps all."""
    return df.orderBy("sentence_id").limit(n) if n else df


def non_blank(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows whose text is more than white space."""
    return df.where(~is_blank(F.col(column)))
