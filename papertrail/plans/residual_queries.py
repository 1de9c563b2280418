"""Queries over residual cells, repeated blocks and corpus integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail.functions import scalars as S
from papertrail.operators import fingerprints as FP
from papertrail.operators import quality as Q
from papertrail.operators import residuals as D
from papertrail.plans import bindings as B
from papertrail.plans.registry import cte, query
from papertrail.session import materialise

MAPS = 5


def residuals(t):
    """Events as residual cells: six by six cells of hour and day, a map per type."""
    return t.events.groupBy(
        F.col("user_id").alias("case_id"), F.col("event_type").alias("map_id"),
        F.floor(F.hour("ts") / 4).cast("int").alias("cell_x"), F.floor(F.day("ts") / 6).cast("int").alias("cell_y")).agg(
        F.max("value").alias("value"))


def suppressed(t):
    return residuals(t).filter((F.col("map_id") == "error") & (F.col("value") > 60))


def hotspots(t):
    return D.stable_hotspots(residuals(t), suppressed(t), MAPS, z_min=0.1, share=0.4)


cte("residuals", """
  SELECT user_id AS case_id, event_type AS map_id, CAST(hour(ts) // 4 AS INT) AS cell_x, CAST(day(ts) // 6 AS INT) AS cell_y,
         max(value) AS value FROM events GROUP BY ALL""")
cte("zscores", """
  SELECT *, least(1, greatest(0, (value - med) / (8 * (mad + 1e-3::DOUBLE)))) AS z FROM residuals
  JOIN (SELECT case_id, map_id, median(value) AS med FROM residuals GROUP BY ALL) USING (case_id, map_id)
  JOIN (SELECT case_id, map_id, median(abs(value - m)) AS mad FROM residuals
        JOIN (SELECT case_id, map_id, median(value) AS m FROM residuals GROUP BY ALL) USING (case_id, map_id) GROUP BY ALL)
    USING (case_id, map_id)""", "residuals")
cte("hot_cells", f"""
  SELECT case_id, cell_x, cell_y, stability, mid * stability AS composite, stability >= 0.4::DOUBLE AS stable FROM (
    SELECT case_id, cell_x, cell_y, median(z) AS mid, count(*) FILTER (z > 0.1::DOUBLE) / {MAPS} AS stability FROM zscores GROUP BY ALL) h
  WHERE NOT EXISTS (SELECT 1 FROM residuals s WHERE s.map_id = 'error' AND s.value > 60 AND s.case_id = h.case_id
                      AND s.cell_x = h.cell_x AND s.cell_y = h.cell_y)""", "zscores", "residuals")


@query("robust_z", "SELECT case_id, map_id, cell_x, cell_y, fix(z, 5) AS z FROM zscores", ("zscores",))
def _(t):
    return D.robust_z(residuals(t), ["case_id", "map_id"], "value", 8.0).select(
        "case_id", "map_id", "cell_x", "cell_y", S.fix("z", 5).alias("z"))


@query("stable_hotspots", """
  SELECT case_id, cell_x, cell_y, stability, fix(composite, 5) AS composite, stable FROM hot_cells""", ("hot_cells",))
def _(t):
    return hotspots(t).withColumn("composite", S.fix("composite", 5))


STATS = """
  SELECT case_id, quantile_cont(composite, 0.5) AS median, quantile_cont(composite, 0.9) AS p90,
         quantile_cont(composite, 0.95) AS p95, avg(CAST(stable AS DOUBLE)) AS area,
         coalesce(avg(stability) FILTER (stable), 0) AS stability FROM hot_cells GROUP BY case_id"""


@query("hotspot_stats", f"""
  SELECT case_id, fix(median, 5) AS median, fix(p90, 5) AS p90, fix(p95, 5) AS p95, fix(area, 5) AS area,
         fix(stability, 5) AS stability FROM ({STATS})""", ("hot_cells",))
def _(t):
    return D.hotspot_stats(hotspots(t)).withColumns({c: S.fix(c, 5) for c in ("median", "p90", "p95", "area", "stability")})


@query("localization_score", f"""
  SELECT case_id, fix(l, 5) AS localization,
         fix(least(0.65::DOUBLE, greatest(0, (0.4::DOUBLE * p95 + 0.3::DOUBLE * stability + 0.3::DOUBLE * l) * l)), 5) AS score
  FROM (SELECT *, least(1, greatest(0, 1 - greatest(0, area - 0.04::DOUBLE) / 0.18::DOUBLE)) AS l FROM ({STATS}))""", ("hot_cells",))
def _(t):
    return D.localization_score(D.hotspot_stats(hotspots(t))).select(
        "case_id", S.fix("localization", 5).alias("localization"), S.fix("score", 5).alias("score"))


@query("hotspot_blobs", """
  WITH RECURSIVE hot AS (SELECT case_id, cell_x, cell_y, composite, cell_x * 100 + cell_y AS node FROM hot_cells WHERE stability >= 0.2::DOUBLE),
  reach(case_id, node, seen) AS (
    SELECT case_id, node, node FROM hot UNION
    SELECT r.case_id, r.node, n.node FROM reach r JOIN hot s ON s.case_id = r.case_id AND s.node = r.seen
      JOIN hot n ON n.case_id = r.case_id AND abs(n.cell_x - s.cell_x) <= 1 AND abs(n.cell_y - s.cell_y) <= 1)
  SELECT case_id, cells, x0, y0, x1, y1, score FROM (
    SELECT h.case_id, component, count(*) AS cells, min(cell_x) AS x0, min(cell_y) AS y0, max(cell_x) AS x1, max(cell_y) AS y1,
           fix(avg(composite), 5) AS score
    FROM hot h JOIN (SELECT case_id, node, min(seen) AS component FROM reach GROUP BY ALL) c USING (case_id, node)
    GROUP BY ALL) WHERE cells >= 2""", ("hot_cells",))
def _(t):
    hot = hotspots(t).filter(F.col("stability") >= 0.2).select("case_id", "cell_x", "cell_y", F.col("composite").alias("score"))
    return D.hotspot_blobs(hot).withColumn("score", S.fix("score", 5))


@query("suppression_mask", """
  SELECT case_id, count(*) AS cells, min(cell_x) AS x0, max(cell_x) AS x1, min(cell_y) AS y0, max(cell_y) AS y1 FROM (
    SELECT DISTINCT case_id, cell_x, unnest(range(y0 // 20, (y1 - 1) // 20 + 1)) AS cell_y FROM (
      SELECT case_id, y0, y1, unnest(range(x0 // 20, (x1 - 1) // 20 + 1)) AS cell_x FROM (
        SELECT case_id, greatest(0, CAST(trunc("left" - width * 0.35::DOUBLE) AS INT)) AS x0,
               greatest(0, CAST(trunc(top - height * 0.5::DOUBLE) AS INT)) AS y0,
               least(page_width, CAST(trunc("left" + width * 1.35::DOUBLE) AS INT)) AS x1,
               least(page_height, CAST(trunc(top + height * 1.5::DOUBLE) AS INT)) AS y1 FROM words) WHERE x1 > x0 AND y1 > y0))
  GROUP BY case_id""", ("words",))
def _(t):
    return D.suppression_mask(B.words(t)).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("cells"), F.min("cell_x").alias("x0"), F.max("cell_x").alias("x1"),
        F.min("cell_y").alias("y0"), F.max("cell_y").alias("y1"))


@query("noise_divergence", """
  SELECT case_id, fix(d, 5) AS divergence, fix(least(1, greatest(0, (d - 0.15::DOUBLE) / 0.85::DOUBLE)) * 0.8::DOUBLE, 5) AS score
  FROM (SELECT case_id, abs(coalesce(stddev_pop(value) FILTER (cell_x < 2 AND cell_y < 2), 0) - stddev_pop(value))
                 / greatest(1e-6, stddev_pop(value)) AS d FROM residuals GROUP BY case_id)""", ("residuals",))
def _(t):
    tile = (F.col("cell_x") < 2) & (F.col("cell_y") < 2)
    return D.noise_divergence(residuals(t), tile).withColumns({c: S.fix(c, 5) for c in ("divergence", "score")})


@query("average_hash", """
  SELECT vec_id, string_agg(printf('%x', nibble), '' ORDER BY g) AS fingerprint FROM (
    SELECT vec_id, g, CAST(sum(CAST(v > mean AS INT) * (1 << (3 - CAST(i % 4 AS INT)))) AS INT) AS nibble FROM (
      SELECT vec_id, i, i // 4 AS g, embedding[i + 1]::DOUBLE AS v, avg(embedding[i + 1]::DOUBLE) OVER (PARTITION BY vec_id) AS mean
      FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings)) GROUP BY 1, 2) GROUP BY vec_id""")
def _(t):
    return t.embeddings.select("vec_id", S.average_hash(F.col("embedding").cast("array<double>")).alias("fingerprint"))


def page_prints(t):
    """64 cells a page, each with the words that fall into it; a bit tells whether a cell holds more than the mean."""
    cell = (F.conv(F.substring(F.md5("text"), 1, 4), 16, 10).cast("int") % 64).alias("cell")
    counts = B.tokens(t).filter("doc_id IS NOT NULL").select("doc_id", cell).groupBy("doc_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    pages = counts.groupBy(F.col("doc_id").alias("id")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("cell", "n")).alias("cells"))
    bits = F.expr("aggregate(cells, 0L, (code, c) -> code | if(c.n > total / 64, shiftleft(1L, 63 - c.cell), 0L))")
    return pages.select("id", bits.alias("fingerprint"))


@query("fingerprint_neighbours", """
  WITH cells AS (SELECT doc_id, CAST('0x' || substr(md5(tok), 1, 4) AS INT) % 64 AS i, count(*) AS n FROM tokens GROUP BY 1, 2),
  means AS (SELECT doc_id, sum(n) / 64::DOUBLE AS mean FROM cells GROUP BY 1),
  codes AS (SELECT doc_id, bit_or(CASE WHEN n > mean THEN CAST(1 AS UBIGINT) << (63 - i)::UBIGINT ELSE CAST(0 AS UBIGINT) END) AS code
            FROM cells JOIN means USING (doc_id) GROUP BY 1),
  prints AS (SELECT code, count(*) AS n, min(doc_id) AS id FROM codes GROUP BY 1)
  SELECT lpad(printf('%x', a.code), 16, '0') AS a, lpad(printf('%x', b.code), 16, '0') AS b, CAST(bit_count(xor(a.code, b.code)) AS INT) AS bits,
         a.n AS n_a, b.n AS n_b, a.id AS id_a, b.id AS id_b
  FROM prints a JOIN prints b ON a.code < b.code AND bit_count(xor(a.code, b.code)) <= 8""", ("tokens",))
def _(t):
    # There are far more pairs than fingerprints, so the digits are written before these are paired.
    known = F.struct("id", FP.to_hex(F.col("fingerprint")).alias("digits")).alias("id")
    found = FP.near_copies(page_prints(t).select("fingerprint", known))
    swap = (F.col("a") < 0) & (F.col("b") >= 0)  # longs are in signed order, digits are not

    def side(one: str, other: str):
        def of(column: str):
            return F.when(swap, F.col(column.format(other))).otherwise(F.col(column.format(one)))
        return of("id_{}.digits").alias(one), of("n_{}").alias(f"n_{one}"), of("id_{}.id").alias(f"id_{one}")
    (a, n_a, id_a), (b, n_b, id_b) = side("a", "b"), side("b", "a")
    return found.select(a, b, "bits", n_a, n_b, id_a, id_b)


@query("offset_voting", """
  WITH toks AS (SELECT doc_id AS case_id, regexp_split_to_array(text, '[ \\n\\t\\r]+') AS t FROM documents),
  blocks AS (SELECT case_id, i AS pos, array_to_string(t[i + 1:i + 5], ' ') AS block
             FROM (SELECT case_id, t, unnest(range(len(t) - 4)) AS i FROM toks)),
  shifts AS (SELECT case_id, pos, lead(pos) OVER (PARTITION BY case_id, block ORDER BY pos) - pos AS shift FROM blocks),
  votes AS (SELECT case_id, shift, count(*) AS votes, min(pos) AS first_pos, max(pos) AS last_pos FROM shifts WHERE shift >= 12 GROUP BY ALL),
  rated AS (SELECT *, sum(votes) OVER (PARTITION BY case_id) AS matched FROM votes)
  SELECT case_id, shift, votes, first_pos, last_pos, CAST(matched AS BIGINT) AS matched, fix(votes / matched::DOUBLE, 5) AS ratio,
         fix(least(1, greatest(0, (votes / matched::DOUBLE - 0.25::DOUBLE) / 0.5::DOUBLE)), 5) AS score
  FROM rated WHERE votes >= 12 AND matched >= 6""")
def _(t):
    texts = t.spread("documents", "doc_id").select(F.col("doc_id").alias("case_id"), "text")
    blocks = D.repeated_blocks(texts, F.split("text", B.BLANKS))
    return D.offset_voting(blocks).withColumns({c: S.fix(c, 5) for c in ("ratio", "score")})


@query("changed_cells_box", """
  WITH a AS (SELECT case_id, cell_x, cell_y, max(value) AS value FROM residuals GROUP BY ALL),
  b AS (SELECT case_id, cell_x, cell_y, CASE WHEN value > 300 THEN value + 1 ELSE value END AS value FROM a WHERE value >= 20)
  SELECT case_id, changed, x0, y0, x1, y1, CASE WHEN changed = 0 THEN 'identical'
         WHEN x0 >= 0 AND y0 >= 0 AND x1 <= 4 AND y1 <= 4 THEN 'inside' ELSE 'outside' END AS state
  FROM (SELECT case_id, count(*) FILTER (c) AS changed, min(cell_x) FILTER (c) AS x0, min(cell_y) FILTER (c) AS y0,
               max(cell_x + 1) FILTER (c) AS x1, max(cell_y + 1) FILTER (c) AS y1
        FROM (SELECT case_id, cell_x, cell_y, a.value IS DISTINCT FROM b.value AS c FROM a FULL JOIN b USING (case_id, cell_x, cell_y))
        GROUP BY case_id)""", ("residuals",))
def _(t):
    before = residuals(t).groupBy("case_id", "cell_x", "cell_y").agg(F.max("value").alias("value"))
    after = before.filter(F.col("value") >= 20).withColumn(
        "value", F.when(F.col("value") > 300, F.col("value") + 1).otherwise(F.col("value")))
    return D.changed_cells_box(before, after, (0, 0, 4, 4))


# ----------------------------------------------------------------- corpus integrity
def manifest(t):
    joined = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id", "left")
    kind = F.when(F.col("quality").isNull(), "none").when(F.col("quality") == 1, "copy_move").otherwise("text_replace")
    key, n = F.col("doc_id"), F.col("n_chars")
    name = F.concat(key.cast("string"), F.lit("_"), kind, F.lit(".png"))
    forged = kind != "none"
    return joined.select(
        F.concat(F.lit("DOC-"), F.when(n % 211 == 0, key - 1).otherwise(key).cast("string")).alias("id"),
        F.col("lang").alias("doc_type"), kind.alias("manipulation"),
        F.concat(F.lit("originals/"), key.cast("string"), F.lit(".png")).alias("original_path"),
        F.when(forged, F.concat(F.lit("forged/"), name)).alias("forged_path"),
        F.when(forged & (n % 29 != 0), F.concat(F.lit("masks/"), F.when(n % 31 == 0, F.lit("m")).otherwise(F.lit("")), name))
        .alias("mask_path"),
        F.when(forged, F.array((n % 90).cast("int"), F.lit(10), (n % 90 + 40).cast("int"), F.lit(60))).alias("region_box"))


def files(t, listed=None):
    listed = manifest(t) if listed is None else listed
    masked = F.col("mask_path").isNotNull() & (F.col("region_box")[0] != 13)
    own = F.array(*[F.struct(F.lit(c).alias("category"), path.alias("path")) for c, path in (
        ("originals", F.col("original_path")), ("forged", F.col("forged_path")), ("masks", F.when(masked, F.col("mask_path"))))])
    more = t.benchmark.select(F.lit("masks").alias("category"), F.concat(F.lit("masks/b"), F.col("item_id").cast("string"), F.lit(".png")).alias("path"))
    return listed.select(F.inline(own)).filter("path IS NOT NULL").unionByName(more)


cte("manifest", """
  SELECT 'DOC-' || CASE WHEN n_chars % 211 = 0 THEN doc_id - 1 ELSE doc_id END AS id, lang AS doc_type, kind AS manipulation,
         'originals/' || doc_id || '.png' AS original_path, CASE WHEN kind <> 'none' THEN 'forged/' || name END AS forged_path,
         CASE WHEN kind <> 'none' AND n_chars % 29 <> 0 THEN 'masks/' || CASE WHEN n_chars % 31 = 0 THEN 'm' ELSE '' END || name END
           AS mask_path, CASE WHEN kind <> 'none' THEN n_chars % 90 END AS box_x
  FROM (SELECT *, doc_id || '_' || kind || '.png' AS name FROM (
    SELECT d.doc_id, lang, n_chars, CASE WHEN quality IS NULL THEN 'none' WHEN quality = 1 THEN 'copy_move' ELSE 'text_replace' END AS kind
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))""")
cte("files", """
  SELECT 'originals' AS category, original_path AS path FROM manifest
  UNION ALL SELECT 'forged', forged_path FROM manifest WHERE forged_path IS NOT NULL
  UNION ALL SELECT 'masks', mask_path FROM manifest WHERE mask_path IS NOT NULL AND box_x <> 13
  UNION ALL SELECT 'masks', 'masks/b' || item_id || '.png' FROM benchmark""", "manifest")
PAIRING = """
  SELECT 'missing-mask' AS problem, id AS name FROM manifest m WHERE manipulation <> 'none'
    AND NOT EXISTS (SELECT 1 FROM files f WHERE f.category = 'masks' AND f.path = m.mask_path)
  UNION ALL SELECT 'orphan-mask', path FROM files f WHERE category = 'masks'
    AND NOT EXISTS (SELECT 1 FROM manifest m WHERE m.mask_path = f.path)
  UNION ALL SELECT 'name-mismatch', id FROM manifest WHERE manipulation <> 'none'
    AND string_split(mask_path, '/')[-1] <> string_split(forged_path, '/')[-1]"""


@query("pairing_checks", PAIRING, ("manifest", "files"))
def _(t):
    return Q.pairing_problems(manifest(t), files(t))


def _named(name):
    return f"(SELECT DISTINCT string_split(path, '/')[-1] AS name FROM files WHERE category = '{name}')"


@query("set_symmetric_diff", f"""
  SELECT name, 'left' AS side FROM (SELECT name FROM {_named('forged')} EXCEPT SELECT name FROM {_named('masks')})
  UNION ALL SELECT name, 'right' FROM (SELECT name FROM {_named('masks')} EXCEPT SELECT name FROM {_named('forged')})""", ("files",))
def _(t):
    named = files(t).select("category", Q.file_name(F.col("path")).alias("name"))
    side = {c: named.filter(F.col("category") == c).select("name").distinct() for c in ("forged", "masks")}
    return Q.symmetric_difference(side["forged"], side["masks"])


EXPECTED = {"originals": 1000, "forged": 399, "types": {"en": 600, "fr": 150}}


@query("validator_report", f"""
  WITH names AS (SELECT name, bool_or(category = 'originals') AS o, bool_or(category <> 'originals') AS x,
                        bool_or(category = 'forged') AS f, bool_or(category = 'masks') AS m
                 FROM (SELECT category, string_split(path, '/')[-1] AS name FROM files) GROUP BY name),
  problems AS ({PAIRING}),
  checks AS (
    SELECT 'count/originals' AS "check", abs(count(*) FILTER (category = 'originals') - 1000) AS problems FROM files
    UNION ALL SELECT 'count/forged', abs(count(*) FILTER (category = 'forged') - 399) FROM files
    UNION ALL SELECT 'count/masks', abs(count(*) FILTER (category = 'masks') - 399) FROM files
    UNION ALL SELECT 'count/manifest', abs(count(*) FILTER (manipulation = 'none') - 1000) + abs(count(*) FILTER (manipulation <> 'none') - 399) FROM manifest
    UNION ALL SELECT 'count/type/en', abs(count(*) FILTER (doc_type = 'en') - 600) FROM manifest
    UNION ALL SELECT 'count/type/fr', abs(count(*) FILTER (doc_type = 'fr') - 150) FROM manifest
    UNION ALL SELECT 'uniqueness/filenames', count(*) FROM (SELECT category, string_split(path, '/')[-1] AS name FROM files GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT 'uniqueness/no_original_name_collision', count(*) FILTER (o AND x) FROM names
    UNION ALL SELECT 'uniqueness/mask_names_match_forged', count(*) FILTER (f <> m) FROM names
    UNION ALL SELECT 'uniqueness/ids', count(*) - count(DISTINCT id) FROM manifest
    UNION ALL SELECT 'pairing/mask_exists', count(*) FILTER (problem = 'missing-mask') FROM problems
    UNION ALL SELECT 'pairing/no_orphan_masks', count(*) FILTER (problem = 'orphan-mask') FROM problems
    UNION ALL SELECT 'pairing/mask_name', count(*) FILTER (problem = 'name-mismatch') FROM problems
    UNION ALL SELECT 'pairing/paths_exist', count(*) FROM (SELECT unnest([original_path, forged_path]) AS p FROM manifest)
      WHERE p IS NOT NULL AND p NOT IN (SELECT path FROM files)
    UNION ALL SELECT 'pairing/manifest_fields', count(*) FILTER (manipulation <> 'none' AND mask_path IS NULL) FROM manifest)
  SELECT "check", CAST(problems AS BIGINT) AS problems, problems = 0 AS ok FROM checks""", ("manifest", "files"))
def _(t):
    listed = materialise(manifest(t))
    return Q.validate_corpus(listed, files(t, listed), EXPECTED["originals"], EXPECTED["forged"], EXPECTED["types"])


@query("box_tolerance", """
  SELECT l_orderkey, l_linenumber, l_partkey, greatest(abs(d), abs(d + l_linenumber % 2)) <= 2 AS close,
         w > 0 AND d >= 0 AND d + l_linenumber % 2 <= 0 AS contained
  FROM (SELECT *, l_suppkey % 5 - 1 AS d, CAST(l_quantity AS INT) AS w FROM lineitem)""")
def _(t):
    x, y = (F.col("l_partkey") % 100).cast("int"), (F.col("l_suppkey") % 100).cast("int")
    w, d = F.col("l_quantity").cast("int"), (F.col("l_suppkey") % 5 - 1).cast("int")
    outer = F.array(x, y, x + w, y + w)
    inner = F.array(x + d, y + d, x + w + d + F.col("l_linenumber") % 2, y + w + d)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", Q.boxes_close(outer, inner).alias("close"),
                             Q.box_contains(outer, inner).alias("contained"))


@query("pilot_rules", """
  WITH pilot AS (SELECT CASE WHEN n_chars % 97 = 0 THEN d.doc_id - 1 ELSE d.doc_id END AS case_id,
           CASE WHEN n_chars % 41 = 0 THEN 'unknown' WHEN quality = 0 THEN 'manipulated' ELSE 'genuine' END AS status,
           n_chars % 11 <> 0 AND quality = 0 OR n_chars % 43 = 0 AS masked, quality = 0 AS changed, n_chars % 500 AS x
         FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
  SELECT case_id, 'invalid-status' AS problem FROM pilot WHERE status = 'unknown'
  UNION ALL SELECT case_id, 'incomplete-manipulated' FROM pilot WHERE status = 'manipulated' AND NOT masked
  UNION ALL SELECT case_id, 'region-outside-image' FROM pilot WHERE status = 'manipulated' AND masked AND x + 80 > 500
  UNION ALL SELECT case_id, 'genuine-claims-change' FROM pilot WHERE status = 'genuine' AND (masked OR changed)
  UNION ALL SELECT case_id, 'duplicate-id' FROM pilot GROUP BY case_id HAVING count(*) > 1""")
def _(t):
    n, q = F.col("n_chars"), F.col("quality")
    pilot = t.documents.join(t.labels, "doc_id").select(
        F.when(n % 97 == 0, F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("case_id"),
        F.when(n % 41 == 0, "unknown").when(q == 0, "manipulated").otherwise("genuine").alias("status"),
        F.when((n % 11 != 0) & (q == 0) | (n % 43 == 0), "masks/x.png").alias("mask_path"),
        F.when(q == 0, F.array(F.lit("name"))).otherwise(F.array().cast("array<string>")).alias("fields_changed"),
        F.when(q == 0, F.array((n % 500).cast("int"), F.lit(10), F.lit(80), F.lit(20))).alias("bbox"),
        F.array(F.lit(500), F.lit(300)).alias("image_size"))
    return Q.pilot_problems(pilot)


@query("perturb_labels", """
  WITH base AS (SELECT k AS key, l_quantity AS qty, fix(l_extendedprice / l_quantity, 2) AS rate, md5(k || 'tax') AS mt, md5(k || 'digit') AS md
                FROM (SELECT *, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS k FROM lineitem)),
  priced AS (SELECT key, rate, fix(qty * rate, 2) AS amount, ([5, 12, 18])[CAST('0x' || substr(mt, 1, 6) AS INT) % 3 + 1] AS tax_rate,
                    CAST('0x' || substr(md, 1, 6) AS INT) % 9 AS digit,
                    unnest(['none', 'text_replace', 'copy_move', 'whiteout']) AS manipulation FROM base)
  SELECT key, manipulation, tax_rate, amount AS true_amount,
         CASE manipulation WHEN 'text_replace' THEN fix(amount + 1000 * (1 + digit), 2) WHEN 'copy_move' THEN rate WHEN 'whiteout' THEN NULL
              ELSE amount END AS printed_amount, CAST(manipulation <> 'none' AS INT) AS label,
         CASE WHEN manipulation <> 'none' THEN 'amount' END AS altered_field FROM priced""")
def _(t):
    lines = t.lineitem.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                                          F.col("l_partkey").cast("string")).alias("key"), F.col("l_quantity").alias("qty"),
                              S.fix(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("rate"))
    return Q.perturb(lines).withColumn("printed_amount", S.fix("printed_amount", 2))
