"""Container facts and metadata: mismatches, scorecards, notes, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papertrail import constants as C
from papertrail.functions import scalars as S

# Marks of PDF structure. One expression finds them all, so a file is scanned once; a look-ahead leaves what
# follows a mark to the next one.
PDF_MARKS = "|".join([
    r"/Type\s*/Page(?=[^s])", r"/Subtype\s*/Image", r"%%EOF", r"[0-9]+\s+[0-9]+\s+obj", r"/Filter\s*/[A-Za-z0-9+#]+",
    r"/BaseFont\s*/[A-Za-z0-9+\-_,.]+", r"/Encrypt\s+[0-9]+\s+[0-9]+\s+R", r"/JavaScript", r"/JS(?=\s)", r"/OpenAction", r"/Launch",
    r"/ByteRange", r"/SigField", r"/FT\s*/Sig", r"adbe\.pkcs7", r"adobe:ns:meta/", r"/AcroForm", r"/EmbeddedFile", r"/Linearized"])
PDF_COUNTS = {"page_count": "/Type", "image_count": "/Subtype", "eof_count": "%%EOF"}
PDF_FLAGS = {"encrypted": ["/Encrypt"], "javascript": ["/JavaScript", "/JS", "/OpenAction", "/Launch"],
             "signed": ["/ByteRange", "/SigField", "/FT", "adbe"], "xmp": ["adobe:"], "acro_form": ["/AcroForm"],
             "embedded_files": ["/EmbeddedFile"], "linearized": ["/Linearized"]}
PDF_SETS = {"filters": r"^/Filter\s*/", "fonts": r"^/BaseFont\s*/"}
PDF_ENTRIES = {"producer": "Producer", "creator": "Creator", "title": "Title", "author": "Author", "creation_date": "CreationDate",
               "mod_date": "ModDate"}
PDF_ENTRY = r"/(?:" + "|".join(PDF_ENTRIES.values()) + r")\s*\([^){}]{0,180}\)"


def markup_facts(text: Column, counts: dict[str, str], firsts: dict[str, str], flags: dict[str, str],
                 sets: dict[str, str]) -> list[Column]:
    """Counts, first captures, presence flags and distinct captures over the whole text."""
    return ([F.regexp_count(text, F.lit(p)).cast("bigint").alias(n) for n, p in counts.items()]
            + [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")).alias(n) for n, p in firsts.items()]
            + [text.rlike(p).alias(n) for n, p in flags.items()]
            + [F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(1)))).alias(n)
               for n, p in sets.items()])


def pdf_facts(content: DataFrame) -> DataFrame:
    """Structural facts of PDF bytes (column ``content``): version, entries of the document information, counts, flags, distinct
    filters and fonts, from one scan for all marks and one for the entries, over the whole file.

    Null content has no marks (its version is unknown, its page count 1); an entry that is absent or blank is null.
    """
    text = F.coalesce(F.decode("content", "ISO-8859-1"), F.lit(""))
    found = content.select("case_id", F.regexp_extract_all(text, F.lit(PDF_MARKS), F.lit(0)).alias("marks"),
                           F.regexp_extract_all(text, F.lit(PDF_ENTRY), F.lit(0)).alias("entries"),
                           F.coalesce(F.nullif(F.regexp_extract(text, r"%PDF-([0-9]\.[0-9])", 1), F.lit("")), F.lit("unknown")).alias("version"))

    def having(start: str) -> Column:
        return F.filter("marks", lambda m: m.startswith(start))

    def entry(key: str) -> Column:
        first = F.get(F.filter("entries", lambda e: e.rlike(f"^/{key}\\s*\\(")), 0)
        return F.nullif(F.trim(F.regexp_extract(first, r"\(([^)]*)\)", 1)), F.lit(""))

    counts = {n: F.size(having(m)).cast("bigint") for n, m in PDF_COUNTS.items()}
    flags = {n: _any_mark(starts) for n, starts in PDF_FLAGS.items()}
    sets = {n: F.array_sort(F.array_distinct(F.transform(F.filter("marks", _matching(p)), _after_slash))) for n, p in PDF_SETS.items()}
    objects = F.size(F.filter("marks", lambda m: m.endswith("obj"))).cast("bigint")
    facts = found.withColumns({**counts, **flags, **sets, "object_count": objects, **{n: entry(k) for n, k in PDF_ENTRIES.items()}})
    return facts.withColumns({"page_count": F.greatest(F.lit(1).cast("bigint"), "page_count"), "font_count": F.size("fonts"),
                              "incremental_updates": F.greatest(F.lit(0).cast("bigint"), F.col("eof_count") - 1)}).drop("marks", "entries")


def _any_mark(starts: list[str]) -> Column:
    def hit(mark: Column) -> Column:
        found = F.lit(False)
        for start in starts:
            found = found | mark.startswith(start)
        return found
    return F.exists("marks", hit)


def _matching(pattern: str):
    return lambda mark: mark.rlike(pattern)


def _after_slash(mark: Column) -> Column:
    """What follows the last slash of a mark."""
    return F.regexp_extract(mark, "([^/]*)$", 1)


def type_mismatch(declared: Column, kind: Column) -> Column:
    """Which rule a declared type breaks: image over PDF, or PDF over something else."""
    return (F.when(declared.startswith("image/") & (kind == "pdf"), "image-over-pdf")
            .when(declared.contains("pdf") & (kind != "pdf"), "pdf-over-other"))


def compression_layer(facts: DataFrame, guard: float = 72) -> DataFrame:
    """Re-save evidence from the stored quality; unknown quality is neutral."""
    q = F.col("quantization_quality")
    low = q < guard
    score = F.when(low, S.clip((guard - q) / 22, 0.05, 1.0)).otherwise(0.0)
    return facts.select("case_id", q.alias("quality"), score.alias("score"),
                        F.when(low, S.clip(0.5 + 0.4 * score, 0.5, 0.92)).otherwise(0.0).alias("confidence"),
                        F.when(low, "CMP-RESAVE").alias("code"), F.when(low, S.severity_band(score)).alias("severity"))


def metadata_layer(meta: DataFrame, keys: list[str]) -> DataFrame:
    """Self-consistency of embedded metadata; missing metadata is neutral."""
    created, modified = S.parse_timestamp(F.col("created")), S.parse_timestamp(F.col("modified"))
    software = F.lower("software")
    issues = F.array_compact(F.array(
        F.when(modified < created, "modified-before-created"),
        F.when(software.contains("word") | software.contains("excel") | software.contains("powerpoint"),
               "office-software")))
    n = F.size("issues")
    score = F.least(F.lit(1.0), n / 3)
    return meta.withColumn("issues", issues).select(
        *keys, "issues", score.alias("score"),
        F.when(n > 0, S.clip(0.4 + 0.4 * score, 0.4, 0.85)).otherwise(0.0).alias("confidence"))


def _drivers() -> list[tuple[Column, float, str]]:
    q = F.col("quantization_quality")
    return [
        (~F.col("exif_present") & ~F.col("xmp_present"), 0.18, "no-exif-xmp"),
        (F.col("type_mismatch"), 0.24, "type-mismatch"),
        (q >= 94, 0.14, "near-lossless"),
        ((q <= 62) & (F.col("kind") == "jpeg"), 0.10, "aggressive-recompression"),
        (F.col("incremental_updates") > 0, 0.22, "revisions"),
        (F.col("crc_error"), 0.26, "crc"),
        (F.col("software").rlike(C.EDITOR_HINTS), 0.16, "editor"),
        (F.col("javascript"), 0.12, "javascript")]


def suspicion_scorecard(facts: DataFrame) -> DataFrame:
    """Container suspicion 0.08 … 0.95 with the drivers that raised it."""
    total = F.lit(0.08)
    for hit, weight, _ in _drivers():
        total = total + F.when(hit, weight).otherwise(0.0)
    names = F.array_compact(F.array(*[F.when(hit, name) for hit, _, name in _drivers()]))
    return facts.withColumns({"suspicion": F.least(F.lit(0.95), total), "drivers": names})


def compression_generation(scored: DataFrame) -> DataFrame:
    """Likelihood of a previous lossy generation, from suspicion, quality and filters."""
    q = F.col("quantization_quality")
    by_quality = F.when(q >= 94, 0.20).when((q >= 76) & (q <= 92), 0.0).when(q.isNotNull(), 0.12).otherwise(0.0)
    lossy = F.when(F.exists("filters", lambda f: f.rlike("(?i)DCTDecode")), 0.12).otherwise(0.0)
    raw = 0.08 + F.col("suspicion") * 0.4 + by_quality + lossy
    raster = F.col("kind").isin("jpeg", "png", "raster")
    return scored.select("case_id", S.clip(F.when(raster, raw).otherwise(raw * 0.75), 0, 1).alias("score"))


def metadata_entries(facts: DataFrame) -> DataFrame:
    """Facts as (group, key, value, flag) rows, in a fixed order."""
    def entry(group: str, key: str, value: Column, flag: Column, when: Column | None = None) -> Column:
        row = F.struct(F.lit(group).alias("group"), F.lit(key).alias("key"), value.cast("string").alias("value"),
                       flag.cast("string").alias("flag"))
        return row if when is None else F.when(when, row)

    def mark(bad: Column, name: str) -> Column:
        return F.when(bad, name).otherwise("ok")

    def presence(key: str, col: str) -> Column:
        return entry("EXIF / XMP", key, F.when(F.col(col), "present").otherwise("absent"), mark(~F.col(col), "missing"))
    pdf, none = F.col("kind") == "pdf", F.lit(None)
    rows = [
        entry("Container", "Declared MIME", F.col("declared_type"), mark(F.col("type_mismatch"), "tamper")),
        entry("Container", "Detected structure", F.col("kind"), mark(F.col("type_mismatch"), "tamper")),
        entry("Container", "Dimensions", F.format_string("%d × %d px", "width", "height"), none, F.col("width").isNotNull()),
        entry("Container", "Pages", F.col("page_count"), none, F.col("page_count") > 0),
        entry("Container", "Incremental updates", F.col("incremental_updates"),
              mark(F.col("incremental_updates") > 0, "tamper")),
        entry("Container", "Encrypted", F.when(F.col("encrypted"), "yes").otherwise("no"), mark(F.col("encrypted"), "info")),
        entry("Container", "Active content", F.when(F.col("javascript"), "JavaScript present").otherwise("none"),
              mark(F.col("javascript"), "tamper")),
        presence("EXIF block", "exif_present"), presence("XMP packet", "xmp_present"),
        presence("ICC profile", "icc_present"), presence("Embedded thumbnail", "thumbnail_present"),
        entry("Document info", "Producer", F.coalesce("software", F.lit("— not declared")),
              mark(F.col("software").isNull(), "missing"), pdf),
        entry("Document info", "Image XObjects", F.col("image_objects"), none, pdf),
        entry("Document info", "Signature", F.when(F.col("signed"), "digital signature present").otherwise("no signature"),
              mark(~F.col("signed"), "missing"), pdf),
        entry("Toolchain", "Last written by", F.coalesce("software", F.lit("— no software tag")),
              F.when(F.col("software").isNull(), "missing").otherwise("info"))]
    return facts.select("case_id", F.posexplode(F.array_compact(F.array(*rows)))).select(
        "case_id", (F.col("pos") + 1).alias("ord"), "col.*")


def metadata_completeness(entries: DataFrame, scored: DataFrame) -> DataFrame:
    """Score of absent and contradictory metadata fields."""
    editor = F.col("value").rlike("(?i)photoshop|gimp|lightroom|snapseed|canva|affinity|preview|figma")
    counts = entries.groupBy("case_id").agg(
        F.count_if(F.col("flag") == "missing").alias("missing"), F.count_if(F.col("flag") == "tamper").alias("tamper"),
        F.max(editor).alias("editor"))
    joined = counts.join(scored.select("case_id", "suspicion"), "case_id")
    score = (0.1 + F.col("suspicion") * 0.55 + F.col("tamper") * 0.14
             + F.least(F.lit(0.2), F.col("missing") * 0.045) + F.when(F.col("editor"), 0.14).otherwise(0.0))
    return joined.select("case_id", "missing", "tamper", S.clip(score, 0, 1).alias("score"),
                         F.when(F.col("missing") >= 4, "medium").when(F.col("missing") >= 2, "low")
                         .otherwise("benign").alias("severity"))


def metadata_groups(entries: DataFrame) -> DataFrame:
    """Entries of a case by group (a case has a fixed, short list of entries)."""
    return entries.groupBy("case_id", "group").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "key"))),
                                                               lambda e: e["key"]).alias("keys"))


def signature_posture(facts: DataFrame) -> DataFrame:
    pdf = F.col("kind") == "pdf"
    return facts.select("case_id", F.when(~pdf, "not-applicable").when(F.col("signed"), "signed").otherwise("unsigned")
                        .alias("posture"),
                        F.when(~pdf, "info").when(F.col("signed"), "benign").otherwise("medium").alias("severity"))


def host_is_suspicious(host: Column) -> Column:
    """Link shortener, dotted-quad address or .io domain."""
    return host.rlike(r"bit\.ly|[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\.io$")


def container_notes(facts: DataFrame) -> DataFrame:
    """Observations about a container as sentences, in rule order. Figures that were not read show as ``?``."""
    kind = F.col("kind")

    def figure(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("?"))
    notes = [
        F.when(kind == "pdf", F.concat(F.lit("PDF "), F.coalesce("version", F.lit("unknown")), F.lit(", "), figure("page_count"), F.lit(" page object(s), "),
                                       figure("object_count"), F.lit(" indirect objects."))),
        F.when(kind == "png", F.concat(F.lit("PNG "), figure("width"), F.lit("×"), figure("height"), F.lit(", "), figure("idat_count"), F.lit(" IDAT chunk(s)."))),
        F.when(kind == "jpeg", F.format_string("Quantisation-derived IJG quality ≈ %s.",
                                               F.coalesce(F.col("quantization_quality").cast("int").cast("string"),
                                                          F.lit("n/a")))),
        F.when((kind == "jpeg") & (F.col("table_count") > 1), "Multiple quantisation table segments."),
        F.when((kind == "png") & F.col("crc_error"), "CRC mismatch in chunk(s)."),
        F.when((kind == "png") & (F.col("trailing_bytes") > 0),
               F.format_string("%d trailing byte(s) after IEND.", "trailing_bytes")),
        F.when((kind == "pdf") & (F.col("incremental_updates") > 0),
               F.format_string("%d incremental update(s) present.", "incremental_updates")),
        F.when((kind == "pdf") & ~F.col("signed"), "No qualified signature."),
        F.when(kind == "unknown", "Container not recognised."),
        F.when(F.col("type_mismatch"), "Declared MIME contradicts byte structure.")]
    return facts.select("case_id", F.array_compact(F.array(*notes)).alias("notes"))


def container_delta(pairs: DataFrame) -> DataFrame:
    """Differences between an exhibit (``a_``) and its reference (``b_``) as notes."""
    same = (F.col("a_width") == F.col("b_width")) & (F.col("a_height") == F.col("b_height"))
    share = (F.col("a_size") - F.col("b_size")) / F.greatest(F.lit(1), F.col("b_size")) * 100

    def retained(col: str) -> Column:
        return F.when(F.col(col), "retained").otherwise("absent")
    notes = [
        F.format_string("Size delta %.2f%% (%d B vs %d B).", S.fix(share, 2), "a_size", "b_size"),
        F.when(F.col("a_width").isNotNull() & F.col("b_width").isNotNull(), F.format_string(
            "Dimensions %s: %d×%d vs %d×%d.", F.when(same, "match").otherwise("differ"), "a_width", "a_height",
            "b_width", "b_height")),
        F.when(F.col("a_quality").isNotNull() & F.col("b_quality").isNotNull(), F.format_string(
            "Quantisation quality delta %d.", F.abs(F.col("a_quality") - F.col("b_quality")).cast("int"))),
        F.concat(F.lit("EXIF presence: "), retained("a_exif"), F.lit(" vs "), retained("b_exif"), F.lit(".")),
        F.when(F.col("a_revisions") != F.col("b_revisions"), F.format_string(
            "Revision count differs: %d vs %d.", "a_revisions", "b_revisions"))]
    return pairs.select("case_id", F.array_compact(F.array(*notes)).alias("notes"))


def container_similarity(pairs: DataFrame) -> DataFrame:
    """1 minus weighted differences of size, width, quality and EXIF; hash identity noted."""
    def differs(a: str, b: str, weight: float) -> Column:
        return F.when(F.col(a).eqNullSafe(F.col(b)), 0.0).otherwise(weight)
    size = F.abs((F.col("a_size") - F.col("b_size")) / F.greatest(F.lit(1), F.col("b_size"))) * 0.4
    loss = (size + differs("a_width", "b_width", 0.2) + differs("a_quality", "b_quality", 0.15)
            + differs("a_exif", "b_exif", 0.15))
    return pairs.select("case_id", S.fix(1 - F.least(F.lit(1.0), loss), 3).alias("similarity"),
                        (F.col("a_sha256") == F.col("b_sha256")).alias("identical"))


def exact_duplicates(hashes: DataFrame) -> DataFrame:
    """Cases sharing a digest: counted per digest, members not gathered."""
    return hashes.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("case_id").alias("first_case")).filter(
        "copies > 1")
