"""Queries over container facts and file content."""

from __future__ import annotations

from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.functions import scalars as S
from papertrail.functions.arrow import byte_entropy
from papertrail.operators import facts as K
from papertrail.plans import bindings as B
from papertrail.plans.registry import cte, query
from papertrail.sources import intake as I

MAGIC = ["FFD8FFE0", "89504E470D0A1A0A", "255044462D312E37", "", ""]
MIMES = ["text/html", "image/png", "application/pdf", ""]
SOFTWARE = ["Adobe Photoshop 25", "Microsoft Word", None, "pdfTeX"]


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def exhibits(t):
    """Pages as uploads: a signature by page id in front of the markup."""
    pid = F.col("page_id")
    content = F.concat(F.unhex(_pick(MAGIC, pid)), F.encode("html", "UTF-8"))
    return t.pages.select(pid.alias("case_id"), F.col("url").alias("name"), _pick(MIMES, pid).alias("mime"),
                          (F.octet_length("html") * (1 + pid % 3)).alias("size_bytes"), content.alias("content"), "html")


def facts(t):
    pid = F.col("case_id")
    mime = F.when(F.col("mime") == "", "application/octet-stream").otherwise(F.col("mime"))
    known = exhibits(t).withColumns({"kind": S.sniff_kind(F.col("content"), F.col("mime"), F.col("name")),
                                     "declared_type": mime})
    return known.select(
        "case_id", "name", "size_bytes", "kind", "declared_type",
        K.type_mismatch(F.col("declared_type"), F.col("kind")).isNotNull().alias("type_mismatch"),
        K.type_mismatch(F.col("declared_type"), F.col("kind")).alias("rule"),
        F.when(pid % 10 != 0, 40 + pid % 60).cast("double").alias("quantization_quality"),
        (pid % 2 == 0).alias("exif_present"), (pid % 3 == 0).alias("xmp_present"), (pid % 7 == 0).alias("icc_present"),
        (pid % 13 == 0).alias("thumbnail_present"), (pid % 4).alias("incremental_updates"),
        (pid % 5 == 0).alias("signed_flag"), (pid % 6 < 3).alias("signed"), (pid % 11 == 0).alias("encrypted"),
        F.col("html").contains("<script").alias("javascript"), _pick(SOFTWARE, pid).alias("software"),
        F.concat(F.lit("1."), (pid % 8).cast("string")).alias("version"), (pid % 50 + 3).alias("object_count"), F.when(pid % 6 != 1, pid % 5 + 1).alias("idat_count"),
        (600 + pid % 3 * 100).alias("width"), (800 + pid % 2 * 50).alias("height"), (1 + pid % 3).alias("page_count"),
        (pid % 6).alias("image_objects"), (pid % 9 == 0).alias("crc_error"), (pid % 8 * 16).alias("trailing_bytes"),
        (1 + pid % 2).alias("table_count"), F.sha2("content", 256).alias("sha256"),
        F.when(pid % 3 == 0, F.array(F.lit("DCTDecode"))).when(pid % 3 == 1, F.array(F.lit("FlateDecode")))
        .otherwise(F.array().cast("array<string>")).alias("filters"))


_arr = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"
cte("exhibits", f"""
  SELECT page_id AS case_id, url AS name, ({_arr(MIMES)})[page_id % 4 + 1] AS mime,
         strlen(html) * (1 + page_id % 3) AS size_bytes, html,
         ({_arr(MAGIC)})[page_id % 5 + 1] || hex(encode(html)) AS hexed FROM pages""")
cte("facts", f"""
  SELECT *, rule IS NOT NULL AS type_mismatch FROM (
  SELECT *, CASE WHEN declared_type LIKE 'image/%' AND kind = 'pdf' THEN 'image-over-pdf'
                 WHEN declared_type LIKE '%pdf%' AND kind <> 'pdf' THEN 'pdf-over-other' END AS rule FROM (
  SELECT case_id, name, size_bytes, html, hexed,
         CASE WHEN mime = '' THEN 'application/octet-stream' ELSE mime END AS declared_type,
         CASE WHEN hexed LIKE 'FFD8%' THEN 'jpeg' WHEN hexed LIKE '89504E470D0A1A0A%' THEN 'png'
              WHEN hexed LIKE '25504446%' THEN 'pdf'
              WHEN mime LIKE 'image/%' OR regexp_matches(lower(name), '\\.(png|jpe?g|webp|tiff?|bmp|heic)$') THEN 'raster'
              ELSE 'unknown' END AS kind,
         CASE WHEN case_id % 10 <> 0 THEN CAST(40 + case_id % 60 AS DOUBLE) END AS q, case_id % 2 = 0 AS exif,
         case_id % 3 = 0 AS xmp, case_id % 7 = 0 AS icc, case_id % 13 = 0 AS thumb, case_id % 4 AS revisions,
         case_id % 6 < 3 AS signed, case_id % 11 = 0 AS encrypted, contains(html, '<script') AS js,
         '1.' || (case_id % 8) AS version, case_id % 50 + 3 AS objects, CASE WHEN case_id % 6 <> 1 THEN case_id % 5 + 1 END AS idats,
         ({_arr(SOFTWARE)})[case_id % 4 + 1] AS software, 600 + case_id % 3 * 100 AS width,
         800 + case_id % 2 * 50 AS height, 1 + case_id % 3 AS page_count, case_id % 6 AS image_objects,
         case_id % 9 = 0 AS crc, case_id % 8 * 16 AS trail, 1 + case_id % 2 AS tables,
         sha256(unhex(hexed)) AS sha
  FROM exhibits))""", "exhibits")
cte("scored", """
  SELECT *, least(0.95::DOUBLE, 0.08::DOUBLE + CASE WHEN NOT exif AND NOT xmp THEN 0.18 ELSE 0 END
     + CASE WHEN type_mismatch THEN 0.24 ELSE 0 END + CASE WHEN q >= 94 THEN 0.14 ELSE 0 END
     + CASE WHEN q <= 62 AND kind = 'jpeg' THEN 0.10 ELSE 0 END + CASE WHEN revisions > 0 THEN 0.22 ELSE 0 END
     + CASE WHEN crc THEN 0.26 ELSE 0 END + CASE WHEN software LIKE '%Photoshop%' THEN 0.16 ELSE 0 END
     + CASE WHEN js THEN 0.12 ELSE 0 END) AS suspicion,
   list_filter([CASE WHEN NOT exif AND NOT xmp THEN 'no-exif-xmp' END, CASE WHEN type_mismatch THEN 'type-mismatch' END,
     CASE WHEN q >= 94 THEN 'near-lossless' END, CASE WHEN q <= 62 AND kind = 'jpeg' THEN 'aggressive-recompression' END,
     CASE WHEN revisions > 0 THEN 'revisions' END, CASE WHEN crc THEN 'crc' END,
     CASE WHEN software LIKE '%Photoshop%' THEN 'editor' END, CASE WHEN js THEN 'javascript' END],
     lambda x: x IS NOT NULL) AS drivers FROM facts""", "facts")


@query("intake_gate", f"""
  SELECT case_id, mime, status, CASE status WHEN 400 THEN 'empty' WHEN 413 THEN 'too-large' WHEN 415 THEN 'unsupported'
         ELSE 'accepted' END AS reason
  FROM (SELECT case_id, mime, CASE WHEN size_bytes = 0 THEN 400 WHEN size_bytes > 20971520 THEN 413
               WHEN NOT (list_bool_or(list_transform({_arr(C.SUPPORTED_TYPES)}, lambda s: contains(mime, s)))
                         OR regexp_matches(lower(name), '\\.(pdf|png|jpe?g|webp|tiff?|bmp|heic)$')) THEN 415
               ELSE 200 END AS status
        FROM (SELECT case_id, name, size_bytes * 1500 AS size_bytes,
                     CASE WHEN mime = '' THEN 'application/octet-stream' ELSE mime END AS mime FROM exhibits))""",
       ("exhibits",))
def _(t):
    sized = exhibits(t).select("case_id", "name", "mime", (F.col("size_bytes") * 1500).alias("size_bytes"))
    return I.intake(sized).select("case_id", "mime", "status", "reason")


@query("reference_mode", """
  SELECT a.case_id, CASE WHEN b.name IS NULL THEN 'reference-free' ELSE 'reference-based' END AS mode, b.name AS reference_name
  FROM exhibits a LEFT JOIN exhibits b ON b.case_id = a.case_id + 1 AND b.size_bytes * 1500 <= 20971520""", ("exhibits",))
def _(t):
    own = exhibits(t).select("case_id", "name", "size_bytes")
    following = own.select((F.col("case_id") - 1).alias("case_id"), "name", (F.col("size_bytes") * 1500).alias("size_bytes"))
    return I.pair_references(own, following).select("case_id", "mode", "reference_name")


@query("container_kind", "SELECT case_id, kind, declared_type FROM facts", ("facts",))
def _(t):
    return facts(t).select("case_id", "kind", "declared_type")


@query("type_mismatch", "SELECT case_id, type_mismatch, rule FROM facts", ("facts",))
def _(t):
    return facts(t).select("case_id", "type_mismatch", "rule")


@query("compression_layer", """
  SELECT case_id, q AS quality, fix(score, 4) AS score,
         fix(CASE WHEN q < 72 THEN least(0.92::DOUBLE, greatest(0.5::DOUBLE, 0.5::DOUBLE + 0.4::DOUBLE * score)) ELSE 0 END, 4)
           AS confidence, CASE WHEN q < 72 THEN 'CMP-RESAVE' END AS code
  FROM (SELECT case_id, q, CASE WHEN q < 72 THEN least(1, greatest(0.05::DOUBLE, (72 - q) / 22)) ELSE 0 END AS score FROM facts)""",
       ("facts",))
def _(t):
    return K.compression_layer(facts(t)).select("case_id", "quality", S.fix("score", 4).alias("score"),
                                                S.fix("confidence", 4).alias("confidence"), "code")


@query("suspicion_scorecard", """
  SELECT case_id, fix(suspicion, 4) AS suspicion, array_to_string(drivers, ',') AS drivers FROM scored""", ("scored",))
def _(t):
    return K.suspicion_scorecard(facts(t)).select("case_id", S.fix("suspicion", 4).alias("suspicion"),
                                                  F.array_join("drivers", ",").alias("drivers"))


@query("compression_generation", """
  SELECT case_id, fix(least(1, greatest(0, CASE WHEN kind IN ('jpeg', 'png', 'raster') THEN s ELSE s * 0.75::DOUBLE END)), 4) AS score
  FROM (SELECT *, 0.08::DOUBLE + suspicion * 0.4::DOUBLE
          + CASE WHEN q >= 94 THEN 0.2 WHEN q BETWEEN 76 AND 92 THEN 0 WHEN q IS NOT NULL THEN 0.12 ELSE 0 END
          + CASE WHEN case_id % 3 = 0 THEN 0.12 ELSE 0 END AS s FROM scored)""", ("scored",))
def _(t):
    return K.compression_generation(K.suspicion_scorecard(facts(t))).withColumn("score", S.fix("score", 4))


def _presence(key, col):
    return (f"{{'g': 'EXIF / XMP', 'k': '{key}', 'v': CASE WHEN {col} THEN 'present' ELSE 'absent' END, "
            f"'f': CASE WHEN {col} THEN 'ok' ELSE 'missing' END}}")


cte("entries", f"""
  SELECT case_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY o) AS INT) AS ord, e.g AS "group", e.k AS key,
         e.v AS value, e.f AS flag
  FROM (SELECT case_id, unnest(range(15)) AS o, unnest([
    {{'g': 'Container', 'k': 'Declared MIME', 'v': declared_type, 'f': CASE WHEN type_mismatch THEN 'tamper' ELSE 'ok' END}},
    {{'g': 'Container', 'k': 'Detected structure', 'v': kind, 'f': CASE WHEN type_mismatch THEN 'tamper' ELSE 'ok' END}},
    {{'g': 'Container', 'k': 'Dimensions', 'v': width || ' × ' || height || ' px', 'f': NULL}},
    {{'g': 'Container', 'k': 'Pages', 'v': CAST(page_count AS VARCHAR), 'f': NULL}},
    {{'g': 'Container', 'k': 'Incremental updates', 'v': CAST(revisions AS VARCHAR),
      'f': CASE WHEN revisions > 0 THEN 'tamper' ELSE 'ok' END}},
    {{'g': 'Container', 'k': 'Encrypted', 'v': CASE WHEN encrypted THEN 'yes' ELSE 'no' END,
      'f': CASE WHEN encrypted THEN 'info' ELSE 'ok' END}},
    {{'g': 'Container', 'k': 'Active content', 'v': CASE WHEN js THEN 'JavaScript present' ELSE 'none' END,
      'f': CASE WHEN js THEN 'tamper' ELSE 'ok' END}},
    {_presence('EXIF block', 'exif')}, {_presence('XMP packet', 'xmp')}, {_presence('ICC profile', 'icc')},
    {_presence('Embedded thumbnail', 'thumb')},
    CASE WHEN kind = 'pdf' THEN {{'g': 'Document info', 'k': 'Producer', 'v': coalesce(software, '— not declared'),
      'f': CASE WHEN software IS NULL THEN 'missing' ELSE 'ok' END}} END,
    CASE WHEN kind = 'pdf' THEN {{'g': 'Document info', 'k': 'Image XObjects', 'v': CAST(image_objects AS VARCHAR), 'f': NULL}} END,
    CASE WHEN kind = 'pdf' THEN {{'g': 'Document info', 'k': 'Signature',
      'v': CASE WHEN signed THEN 'digital signature present' ELSE 'no signature' END,
      'f': CASE WHEN signed THEN 'ok' ELSE 'missing' END}} END,
    {{'g': 'Toolchain', 'k': 'Last written by', 'v': coalesce(software, '— no software tag'),
      'f': CASE WHEN software IS NULL THEN 'missing' ELSE 'info' END}}]) AS e FROM facts) WHERE e IS NOT NULL""", "facts")


@query("metadata_entries", "SELECT * FROM entries", ("entries",))
def _(t):
    return K.metadata_entries(facts(t))


@query("metadata_completeness", """
  SELECT case_id, missing, tamper, fix(least(1, 0.1::DOUBLE + suspicion * 0.55::DOUBLE + tamper * 0.14::DOUBLE
           + least(0.2::DOUBLE, missing * 0.045::DOUBLE) + CASE WHEN editor THEN 0.14 ELSE 0 END), 4) AS score,
         CASE WHEN missing >= 4 THEN 'medium' WHEN missing >= 2 THEN 'low' ELSE 'benign' END AS severity
  FROM (SELECT case_id, count(*) FILTER (flag = 'missing') AS missing, count(*) FILTER (flag = 'tamper') AS tamper,
               bool_or(value LIKE '%Photoshop%') AS editor FROM entries GROUP BY case_id) JOIN scored USING (case_id)""",
       ("entries", "scored"))
def _(t):
    known = facts(t)
    return K.metadata_completeness(K.metadata_entries(known), K.suspicion_scorecard(known)).withColumn(
        "score", S.fix("score", 4))


@query("metadata_groups", """
  SELECT case_id, "group", string_agg(key, ',' ORDER BY ord) AS keys FROM entries GROUP BY 1, 2""", ("entries",))
def _(t):
    return K.metadata_groups(K.metadata_entries(facts(t))).withColumn("keys", F.array_join("keys", ","))


@query("signature_posture", """
  SELECT case_id, CASE WHEN kind <> 'pdf' THEN 'not-applicable' WHEN signed THEN 'signed' ELSE 'unsigned' END AS posture,
         CASE WHEN kind <> 'pdf' THEN 'info' WHEN signed THEN 'benign' ELSE 'medium' END AS severity FROM facts""", ("facts",))
def _(t):
    return K.signature_posture(facts(t))


@query("host_reputation", """
  SELECT page_id, host, regexp_matches(host, 'bit\\.ly|[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+|\\.io$') AS suspicious
  FROM (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)""")
def _(t):
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    return t.pages.select("page_id", host.alias("host"), K.host_is_suspicious(host).alias("suspicious"))


@query("container_notes", """
  SELECT case_id, array_to_string(list_filter([
    CASE WHEN kind = 'pdf' THEN 'PDF ' || version || ', ' || page_count || ' page object(s), ' || objects || ' indirect objects.' END,
    CASE WHEN kind = 'png' THEN 'PNG ' || width || '×' || height || ', ' || coalesce(CAST(idats AS VARCHAR), '?') || ' IDAT chunk(s).' END,
    CASE WHEN kind = 'jpeg' THEN 'Quantisation-derived IJG quality ≈ ' || coalesce(CAST(CAST(q AS INT) AS VARCHAR), 'n/a') || '.' END,
    CASE WHEN kind = 'jpeg' AND tables > 1 THEN 'Multiple quantisation table segments.' END,
    CASE WHEN kind = 'png' AND crc THEN 'CRC mismatch in chunk(s).' END,
    CASE WHEN kind = 'png' AND trail > 0 THEN trail || ' trailing byte(s) after IEND.' END,
    CASE WHEN kind = 'pdf' AND revisions > 0 THEN revisions || ' incremental update(s) present.' END,
    CASE WHEN kind = 'pdf' AND NOT signed THEN 'No qualified signature.' END,
    CASE WHEN kind = 'unknown' THEN 'Container not recognised.' END,
    CASE WHEN type_mismatch THEN 'Declared MIME contradicts byte structure.' END], lambda x: x IS NOT NULL), ' ') AS notes
  FROM facts""", ("facts",))
def _(t):
    return K.container_notes(facts(t)).withColumn("notes", F.array_join("notes", " "))


def page_pairs(t):
    """Each page against the next one as its reference."""
    def side(prefix, shift):
        return facts(t).select(
            (F.col("case_id") - shift).alias("case_id"), *[F.col(c).alias(f"{prefix}_{n}") for c, n in (
                ("size_bytes", "size"), ("width", "width"), ("height", "height"), ("quantization_quality", "quality"),
                ("exif_present", "exif"), ("incremental_updates", "revisions"), ("sha256", "sha256"))])
    return side("a", 0).join(side("b", 1), "case_id")


@query("container_delta", """
  SELECT a.case_id, array_to_string(list_filter([
    format('Size delta {:.2f}% ({} B vs {} B).', fix((a.size_bytes - b.size_bytes) / greatest(1, b.size_bytes)::DOUBLE * 100, 2),
           a.size_bytes, b.size_bytes),
    format('Dimensions {}: {}×{} vs {}×{}.', CASE WHEN a.width = b.width AND a.height = b.height THEN 'match' ELSE 'differ' END,
           a.width, a.height, b.width, b.height),
    CASE WHEN a.q IS NOT NULL AND b.q IS NOT NULL THEN 'Quantisation quality delta ' || CAST(abs(a.q - b.q) AS INT) || '.' END,
    'EXIF presence: ' || CASE WHEN a.exif THEN 'retained' ELSE 'absent' END || ' vs '
      || CASE WHEN b.exif THEN 'retained' ELSE 'absent' END || '.',
    CASE WHEN a.revisions <> b.revisions THEN 'Revision count differs: ' || a.revisions || ' vs ' || b.revisions || '.' END],
    lambda x: x IS NOT NULL), ' ') AS notes
  FROM facts a JOIN facts b ON b.case_id = a.case_id + 1""", ("facts",))
def _(t):
    return K.container_delta(page_pairs(t)).withColumn("notes", F.array_join("notes", " "))


@query("container_similarity", """
  SELECT a.case_id, fix(1 - least(1, abs((a.size_bytes - b.size_bytes) / greatest(1, b.size_bytes)::DOUBLE) * 0.4::DOUBLE
           + CASE WHEN a.width IS DISTINCT FROM b.width THEN 0.2 ELSE 0 END
           + CASE WHEN a.q IS DISTINCT FROM b.q THEN 0.15 ELSE 0 END
           + CASE WHEN a.exif IS DISTINCT FROM b.exif THEN 0.15 ELSE 0 END), 3) AS similarity, a.sha = b.sha AS identical
  FROM facts a JOIN facts b ON b.case_id = a.case_id + 1""", ("facts",))
def _(t):
    return K.container_similarity(page_pairs(t))


@query("hashes", """
  SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, substr(sha256(text), 1, 16) AS reference_id
  FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"),
                              F.sha2("text", 256).alias("sha256"),
                              F.substring(F.sha2("text", 256), 1, 16).alias("reference_id"))


@query("case_codes", """
  SELECT doc_id, 'SF-2026-' || (CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 900000 + 100000) AS case_code
  FROM documents""")
def _(t):
    return t.documents.select("doc_id", S.case_code(F.sha2("text", 256), 2026).alias("case_code"))


@query("exact_duplicates", """
  SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_case FROM documents GROUP BY 1 HAVING count(*) > 1""")
def _(t):
    return K.exact_duplicates(t.documents.select(F.col("doc_id").alias("case_id"), F.sha2("text", 256).alias("sha256")))


@query("byte_entropy", """
  SELECT case_id, fix(-sum(n / total::DOUBLE * log2(n / total::DOUBLE)), 3) AS entropy FROM (
    SELECT case_id, byte, count(*) AS n, sum(count(*)) OVER (PARTITION BY case_id) AS total
    FROM (SELECT case_id, substr(hexed, CAST(unnest(range(len(hexed) // 2)) * 2 + 1 AS BIGINT), 2) AS byte FROM exhibits)
    GROUP BY 1, 2) GROUP BY case_id""", ("exhibits",))
def _(t):
    return exhibits(t).select("case_id", byte_entropy(F.col("content")).alias("entropy"))


@query("rolling_fingerprint", """
  WITH sized AS (SELECT case_id, hexed, len(hexed) // 2 AS n, greatest(1, len(hexed) // 2 // 16) AS size FROM exhibits),
  blocks AS (SELECT case_id, hexed, b, b * size AS s, least(n, b * size + size) AS e
             FROM sized CROSS JOIN (SELECT unnest(range(16)) AS b)),
  signed AS (SELECT case_id, b, CASE WHEN e > s THEN list_reduce(list_prepend(0::BIGINT, list_transform(
               range(s, e), lambda i: CAST('0x' || substr(hexed, i * 2 + 1, 2) AS BIGINT))),
               lambda a, x: (a * 31 + x) % 4294967295) % 256 ELSE 0 END AS v FROM blocks)
  SELECT case_id, string_agg(printf('%02x', v), '' ORDER BY b) AS fingerprint FROM signed GROUP BY case_id""", ("exhibits",))
def _(t):
    return exhibits(t).select("case_id", S.rolling_fingerprint(F.col("content")).alias("fingerprint"))


_luma = "[" + ", ".join(map(str, C.STANDARD_LUMA)) + "]"


@query("jpeg_quality", f"""
  WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda v: 1 + CAST(floor(abs(CAST(v AS DOUBLE)) * 400) AS INT)) AS tab FROM embeddings),
  ratios AS (SELECT vec_id, tab, list_sort(list_filter(list_transform(range(1, 65), lambda i:
               CASE WHEN tab[i] > 1 THEN tab[i] * 100.0::DOUBLE / ({_luma})[i] END), lambda r: r IS NOT NULL)) AS rs FROM scaled)
  SELECT vec_id, fix(least(100, greatest(1, CASE WHEN s < 100 THEN (200 - s) / 2 ELSE 5000 / s END)), 1) AS quality,
         CAST(least(100, greatest(1, round_even(CASE WHEN d >= 100 THEN 5000 / d ELSE (200 - d) / 2 END, 0))) AS INT) AS quality_dc
  FROM (SELECT vec_id, rs[len(rs) // 2 + 1] AS s, tab[1] * 100.0::DOUBLE / 16 AS d FROM ratios)""")
def _(t):
    """Tables of 64 whole numbers from the components of the vectors."""
    table = F.transform("embedding", lambda v: 1 + F.floor(F.abs(v.cast("double")) * 400).cast("int"))
    return t.embeddings.select("vec_id", S.jpeg_quality(table).alias("quality"), S.jpeg_quality_dc(table).alias("quality_dc"))


HTML_COUNTS = {"scripts": "<script", "links": "<a ", "paragraphs": "<p", "comments": "<!--", "closes": "</html>"}


@query("markup_facts", """
  SELECT page_id, len(regexp_extract_all(html, '<script')) AS scripts, len(regexp_extract_all(html, '<a ')) AS links,
         len(regexp_extract_all(html, '<p')) AS paragraphs, len(regexp_extract_all(html, '<!--')) AS comments,
         len(regexp_extract_all(html, '</html>')) AS closes,
         nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title,
         contains(html, '<script') AS active,
         array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'class="([a-z]+)"', 1))), ',') AS classes
  FROM pages""")
def _(t):
    found = K.markup_facts(F.col("html"), HTML_COUNTS, {"title": "<title>([^<]*)</title>"}, {"active": "<script"},
                           {"classes": 'class="([a-z]+)"'})
    return t.pages.select("page_id", *found).withColumn("classes", F.array_join("classes", ","))


PDF_TOKENS = ["/Type /Page ", "/Type /Pages", "/Subtype /Image", "%%EOF", "12 0 obj", "/BaseFont /Helvetica", "/BaseFont /Times-Roman", "/AcroForm 3 0 R",
              "/EmbeddedFile", "/Linearized 1", "/Filter /FlateDecode", "/Filter/DCTDecode", "/Encrypt 5 0 R", "/JavaScript", "/JS (x)", "/ByteRange [0]",
              "adobe:ns:meta/", "/Producer (Acme Writer)", "/Creator ( Tool 9 )", "/Title (Report)", "/Author ()", "/ModDate (D:2020)"]


def pdf_texts(t):
    """Documents as files: a header, then the text with a mark of PDF structure in place of some words."""
    doc = F.col("doc_id")
    marks = F.array(*[F.lit(m) for m in PDF_TOKENS])
    def word(token, i):
        at = (i * 7 + doc * 13) % 90
        return F.when((i % 9 == 4) & (at < len(PDF_TOKENS)), F.element_at(marks, (at % len(PDF_TOKENS) + 1).cast("int"))).otherwise(token)
    body = F.array_join(F.transform(F.split("text", B.BLANKS), word), " ")
    head = F.when(doc % 5 == 0, "").otherwise(F.concat(F.lit("%PDF-1."), (doc % 8).cast("string"), F.lit(" ")))
    return t.spread("documents", "doc_id").select(doc.alias("case_id"), F.encode(F.concat(head, body), "UTF-8").alias("content"))


cte("pdf_texts", f"""
  SELECT doc_id AS case_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '%PDF-1.' || (doc_id % 8) || ' ' END || array_to_string(list_transform(
    regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda w, j: CASE WHEN (j - 1) % 9 = 4 AND ((j - 1) * 7 + doc_id * 13) % 90 < {len(PDF_TOKENS)}
      THEN ({"[" + ", ".join(f"'{m}'" for m in PDF_TOKENS) + "]"})[((j - 1) * 7 + doc_id * 13) % 90 + 1] ELSE w END), ' ') AS body FROM documents""")
_FOUND = "len(regexp_extract_all(body, '{}'))"


def _first_entry(key: str) -> str:
    return f"nullif(trim(regexp_extract(body, '/{key}\\s*\\(([^){{}}]{{0,180}})\\)', 1)), '')"


@query("pdf_facts", f"""
  SELECT case_id, coalesce(nullif(regexp_extract(body, '%PDF-([0-9]\\.[0-9])', 1), ''), 'unknown') AS version, {", ".join(
    f"{_first_entry(k)} AS {n}" for n, k in K.PDF_ENTRIES.items())},
    greatest(1, {_FOUND.format("/Type\\s*/Page[^s]")}) AS page_count, {_FOUND.format("/Subtype\\s*/Image")} AS image_count, {_FOUND.format("%%EOF")} AS eof_count,
    greatest(0, {_FOUND.format("%%EOF")} - 1) AS incremental_updates, {_FOUND.format("[0-9]+\\s+[0-9]+\\s+obj")} AS object_count,
    regexp_matches(body, '/Encrypt\\s+[0-9]+\\s+[0-9]+\\s+R') AS encrypted, regexp_matches(body, '/JavaScript|/JS\\s|/OpenAction|/Launch') AS javascript,
    regexp_matches(body, '/ByteRange|/SigField|/FT\\s*/Sig|adbe\\.pkcs7') AS signed, contains(body, 'adobe:ns:meta/') AS xmp, contains(body, '/AcroForm') AS acro_form,
    contains(body, '/EmbeddedFile') AS embedded_files, contains(body, '/Linearized') AS linearized,
    array_to_string(list_sort(list_distinct(regexp_extract_all(body, '/Filter\\s*/([A-Za-z0-9+#]+)', 1))), ',') AS filters,
    array_to_string(list_sort(list_distinct(regexp_extract_all(body, '/BaseFont\\s*/([A-Za-z0-9+\\-_,.]+)', 1))), ',') AS fonts,
    CAST(len(list_distinct(regexp_extract_all(body, '/BaseFont\\s*/([A-Za-z0-9+\\-_,.]+)', 1))) AS INT) AS font_count
  FROM pdf_texts""", ("pdf_texts",))
def _(t):
    return K.pdf_facts(pdf_texts(t)).withColumns({c: F.array_join(c, ",") for c in ("filters", "fonts")})


@query("file_labels", """
  SELECT case_id, CASE WHEN len(last) > 0 AND len(last) <= 5 AND last <> lower(name) THEN last
                       WHEN kind IN ('pdf', 'png') THEN kind WHEN kind = 'jpeg' THEN 'jpg' ELSE 'bin' END AS extension,
         CASE WHEN size_bytes < 1024 THEN size_bytes || ' B'
              WHEN size_bytes < 1048576 THEN printf('%.1f', size_bytes / 1024::DOUBLE) || ' KB'
              ELSE printf('%.2f', size_bytes / 1048576::DOUBLE) || ' MB' END AS size_label,
         substr(sha, 1, 10) || '…' || right(sha, 6) AS hash_label
  FROM (SELECT *, lower(string_split(name, '.')[-1]) AS last FROM facts)""", ("facts",))
def _(t):
    return facts(t).select("case_id", S.extension(F.col("name"), F.col("kind")).alias("extension"),
                           S.format_bytes(F.col("size_bytes")).alias("size_label"),
                           S.short_hash(F.col("sha256")).alias("hash_label"))


STAMPS = ["'D:' || strftime(ts, '%Y%m%d%H%M%S')", "strftime(ts, '%Y:%m:%d %H:%M:%S')", "'sometime in ' || year(ts)"]


@query("parse_timestamps", """
  SELECT event_id, CASE WHEN event_id % 3 < 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def _(t):
    at, form = F.col("ts").cast("timestamp"), F.col("event_id") % 3
    text = (F.when(form == 0, F.concat(F.lit("D:"), F.date_format(at, "yyyyMMddHHmmss")))
            .when(form == 1, F.date_format(at, "yyyy:MM:dd HH:mm:ss")).otherwise(F.concat(F.lit("sometime in "), F.year(at))))
    return t.events.select("event_id", F.date_format(S.parse_timestamp(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("metadata_layer", """
  SELECT l_orderkey, l_linenumber, l_partkey, issues, fix(least(1, n / 3::DOUBLE), 4) AS score,
         fix(CASE WHEN n > 0 THEN least(0.85::DOUBLE, greatest(0.4::DOUBLE, 0.4::DOUBLE + 0.4::DOUBLE * least(1, n / 3::DOUBLE)))
             ELSE 0 END, 4) AS confidence
  FROM (SELECT l_orderkey, l_linenumber, l_partkey,
               array_to_string(list_filter([CASE WHEN o_orderdate < l_shipdate THEN 'modified-before-created' END,
                 CASE WHEN l_returnflag = 'A' THEN 'office-software' END], lambda x: x IS NOT NULL), ',') AS issues,
               CAST(coalesce(o_orderdate < l_shipdate, false) AS INT) + CAST(l_returnflag = 'A' AS INT) AS n
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""")
def _(t):
    software = F.when(F.col("l_returnflag") == "A", "Microsoft Word").when(F.col("l_returnflag") == "R", "Adobe Acrobat")
    meta = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", software.alias("software"),
        F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy:MM:dd HH:mm:ss").alias("created"),
        F.concat(F.lit("D:"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMddHHmmss")).alias("modified"))
    scored = K.metadata_layer(meta, ["l_orderkey", "l_linenumber", "l_partkey"])
    return scored.withColumns({"issues": F.array_join("issues", ","), "score": S.fix("score", 4),
                               "confidence": S.fix("confidence", 4)})
