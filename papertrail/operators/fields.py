"""Identity fields: label phrases among words and the values beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.functions import scalars as S
from papertrail.operators.skew import CROWD, with_following
from papertrail.operators.words import BAND, bands, usable

PHRASES = {}
for _field, _labels in C.FIELD_LABELS.items():
    for _label in _labels:
        _norm = " ".join("".join(ch if ch.isalnum() else " " for ch in _label).split())
        PHRASES.setdefault(_norm, (len(PHRASES), _field))


def _phrase(text: Column, words: int) -> Column:
    """(priority, field, number of words) of a phrase, NULL if it is no label."""
    order = S.lookup({k: v[0] for k, v in PHRASES.items()}, text)
    field = S.lookup({k: v[1] for k, v in PHRASES.items()}, text)
    return F.when(order.isNotNull(), F.struct(order.alias("priority"), field.alias("field_type"),
                                              F.lit(words).alias("words")))


def label_spans(words: DataFrame, floor: float = 20) -> DataFrame:
    """Labels of one to three consecutive readable words on nearly the same line,
    left to right. The phrase listed first wins where several start at a word."""
    tokens = usable(words, floor).withColumn("norm", S.normalize_text(F.col("text")))
    cols = ["idx", "norm", "left", "top", "width", "height"]
    seen = with_following(tokens, ["case_id"], "idx", cols, n=2, most=CROWD)
    drift = F.greatest(F.lit(18.0), F.col("height") * 1.8)

    def fits(i: int, previous_left: str) -> Column:
        return ((F.abs(F.col(f"next{i}_top") - F.col("top")) <= drift)
                & (F.col(f"next{i}_left") >= F.col(previous_left)) & ~F.col(f"next{i}_norm").contains(" "))
    single = ~F.col("norm").contains(" ")
    two = single & fits(1, "left")
    three = two & fits(2, "next1_left")
    hits = F.array_compact(F.array(
        _phrase(F.col("norm"), 1),
        F.when(two, _phrase(F.concat_ws(" ", "norm", "next1_norm"), 2)),
        F.when(three, _phrase(F.concat_ws(" ", "norm", "next1_norm", "next2_norm"), 3))))
    spans = seen.withColumn("hit", F.array_min(hits)).filter(F.col("hit").isNotNull())

    def tail(col: str) -> Column:
        return (F.when(F.col("hit.words") == 1, F.col(col)).when(F.col("hit.words") == 2, F.col(f"next1_{col}"))
                .otherwise(F.col(f"next2_{col}")))
    return spans.select(
        "case_id", F.col("idx").alias("label_idx"), "hit.field_type", F.col("hit.words").alias("label_words"),
        "conf", "left", "top", "height", *[tail(c).alias(f"tail_{c}") for c in ("idx", "left", "top", "width", "height")])


def _values(anchors: DataFrame, words: DataFrame, low: Column, high: Column, condition: Column, order: list[str]) -> DataFrame:
    """The words right of each anchor up to the next label or the end of its line, as an array in ``order``. Anchors are
    copied to the bands their window touches, words sit in one band."""
    placed = anchors.withColumn("band", bands(low, high))
    candidates = words.select("case_id", "idx", *[F.col(c).alias(f"w_{c}") for c in
                                                  ("text", "conf", "left", "top", "width", "height", "is_label")],
                              F.floor(F.col("top") / BAND).alias("band"))
    near = placed.join(candidates, ["case_id", "band"]).filter(condition)
    anchor = Window.partitionBy("case_id", "label_idx")
    ranked = near.withColumn("rank", F.row_number().over(anchor.orderBy(*order)))
    # A label right beside the anchor counts as its value, every later one ends it.
    ended = F.max(F.col("w_is_label") & (F.col("rank") > 1)).over(anchor.orderBy(*order))
    carried = [c for c in anchors.columns if c not in ("case_id", "label_idx")]
    return ranked.withColumn("ended", ended).filter(~F.col("ended")).groupBy("case_id", "label_idx").agg(
        *[F.first(c).alias(c) for c in carried],
        F.array_sort(F.collect_list(F.struct("rank", "w_text", "w_conf", "w_left", "w_top", "w_width", "w_height",
                                             "w_is_label"))).alias("values"))


def _joined_text() -> Column:
    text = F.array_join(F.transform("values", lambda w: F.trim(w["w_text"])), " ")
    return F.regexp_replace(text, "^[ :]+|[ :]+$", "")


def identity_fields(words: DataFrame, floor: float = 20) -> DataFrame:
    """Every label with the value words right of it, up to the next label."""
    readable = usable(words, floor)
    marked = readable.withColumn("is_label", _phrase(S.normalize_text(F.col("text")), 1).isNotNull())
    low = F.col("tail_top") - F.greatest(F.lit(8.0), F.col("tail_height") * 0.5)
    high = F.col("tail_top") + F.greatest(F.lit(24.0), F.col("tail_height") * 1.8)
    right = ((F.col("idx") > F.col("tail_idx")) & (F.col("w_left") > F.col("tail_left") + F.col("tail_width"))
             & (F.col("w_top") <= high) & (F.col("w_top") >= low))
    found = _values(label_spans(words, floor), marked, low, high, right, ["w_top", "w_left", "idx"])
    n = F.size("values")
    mean = F.aggregate("values", F.lit(0.0), lambda a, w: a + w["w_conf"]) / n
    x0 = F.least("left", F.col("values")[0]["w_left"])
    y0 = F.least("top", F.array_min(F.transform("values", lambda w: w["w_top"])))
    x1 = F.array_max(F.transform("values", lambda w: w["w_left"] + w["w_width"]))
    y1 = F.greatest(F.col("top") + F.col("height"), F.array_max(F.transform("values", lambda w: w["w_top"] + w["w_height"])))
    raw = _joined_text()
    return found.select(
        "case_id", "label_idx", "field_type", raw.alias("raw_text"), S.normalize_text(raw).alias("normalized_text"),
        x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"),
        S.fix(S.clip(0.5 * F.col("conf") / 100 + 0.5 * mean / 100, 0, 1), 3).alias("confidence"))


def best_fields(fields: DataFrame) -> DataFrame:
    """Most confident observation per field type, the first on ties."""
    cols = [c for c in fields.columns if c not in ("case_id", "field_type")]
    best = fields.groupBy("case_id", "field_type").agg(F.max_by(
        F.struct(*cols), F.struct("confidence", (-F.col("label_idx")).alias("i"))).alias("b"))
    return best.select("case_id", "field_type", "b.*")


def short_label_values(words: DataFrame, floor: float = 25) -> DataFrame:
    """Conservative variant: nine one-word labels, value on the same line only."""
    plain = F.regexp_replace(F.lower(F.trim("text")), "[:.]+$", "")
    readable = usable(words, floor).withColumn("plain", plain)
    marked = readable.withColumn("is_label", F.col("plain").isin(*C.SHORT_LABELS))
    hits = marked.filter("is_label").groupBy("case_id", F.col("plain").alias("field")).agg(F.min_by(
        F.struct("idx", "left", "top", "width", "height"), F.struct("top", "left", "idx")).alias("a"))
    anchors = hits.select("case_id", F.col("a.idx").alias("label_idx"), "field", "a.left", "a.top", "a.width", "a.height")
    slack = F.greatest(F.lit(12.0), F.col("height") * 0.75)
    same_line = ((F.col("w_left") > F.col("left") + F.col("width")) & (F.abs(F.col("w_top") - F.col("top")) < slack))
    found = _values(anchors, marked, F.col("top") - slack, F.col("top") + slack, same_line, ["w_left", "idx"])
    return found.select("case_id", "field", _joined_text().alias("value")).filter(F.col("value") != "")
