"""Licence scan by canonical digests.

A text is brought to a canonical form (case, punctuation, white space, line breaks,
copyright lines, equivalent spellings), and the digest of the whole form is joined to
the digests of known licence texts. A document is looked up as a whole and line by
line, as a one-line notice is a known text too. Only lines whose form is as long as a
known one (lengths modulo 4096, so their list is bounded) get a digest; the table of
known digests is broadcast after its size was measured, so no line is shuffled.

Only DataFrame operations are used. The table of known digests is the fixed list
of ``licence_texts`` or the caller's. Null and empty texts have an empty form,
which matches nothing. Repeated rows get equal results, extra columns are not
read, and documents are told apart by id and hash of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.llm.common import hex_digest
from equipoise.llm.licence_texts import KNOWN, KNOWN_DIGESTS
from equipoise.operators.ordered import sized_broadcast

#: Equivalent spellings, by word of the canonical form.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense",
    "licencing": "licensing", "licencee": "licensee", "licencees": "licensees", "licencor": "licensor", "licencors": "licensors",
    "sublicencing": "sublicensing",
    "acknowledgement": "acknowledgment", "favour": "favor", "fulfilment": "fulfillment", "judgement": "judgment",
    "noninfringement": "non infringement", "merchantibility": "merchantability", "organisation": "organization",
    "programme": "program", "whilst": "while", "wilful": "willful", "http": "https",
}


#: A line that names a holder or a year, not one of the licence's own sentences: the
#: mark or year follows at once, or a capitalised name does. Postal addresses of the
#: holder and a bare "all rights reserved" belong to it.
_HOLDER = (r"^[^\p{L}\p{N}]*(?:"
           r"(?i:copyright)[^\p{L}\p{N}]*(?:(?i:\(c\))|©|(?:19|20)[0-9]{2}|[<\[{])"
           r"|Copyright\s+(?:by\s+)?(?!License|Notice|Law|Holder|Owner)\p{Lu}"
           r"|(?:(?i:\(c\))|©)[^\p{L}\p{N}]*(?:(?i:copyright)[^\p{L}\p{N}]*)?(?:19|20)[0-9]{2}"
           r"|(?i:all rights reserved)[^\p{L}\p{N}]*$"
           r"|[0-9]+ (?i:Franklin St|Temple Place))")
_LENGTHS = 4096


def canonical_lines(text: Column) -> Column:
    """Per line (cut at line feeds): lower case, words of letters and digits joined by
    single blanks, in one spelling; empty for a copyright line."""
    pairs = F.create_map(*[F.lit(x) for kv in EQUIVALENT.items() for x in kv])

    def form(line: Column) -> Column:
        return F.when(~line.rlike(_HOLDER), F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))).otherwise("")

    def spelled(flat: Column) -> Column:
        # only lines with such a word are taken apart
        one = F.array_join(F.transform(F.split(flat, " "), lambda w: F.coalesce(pairs[w], w)), " ")
        return F.when(flat.rlike(r"\b(?:" + "|".join(EQUIVALENT) + r")\b"), one).otherwise(flat)

    return F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), form), spelled)


def whole_form(lines: Column) -> Column:
    """The canonical form of a text from those of its lines."""
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN,
                  digests: tuple[tuple[str, int, str], ...] = KNOWN_DIGESTS) -> DataFrame:
    """(digest, license, length of the canonical form), one row per digest, of texts
    and of (license, length, digest) rows."""
    rows = spark.createDataFrame(list(known), "license string, text string")
    rows = rows.select("license", whole_form(canonical_lines(F.col("text"))).alias("form")).select(
        hex_digest(F.col("form")).alias("digest"), "license", F.length("form").alias("length"))
    if digests:
        rows = rows.union(spark.createDataFrame(list(digests), "license string, length int, digest string").select(
            "digest", "license", "length"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.max("length").alias("length"))


def scan_licences(spark: SparkSession, docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Per row: id_col, digest of the whole canonical text, license (the known
    licence that the whole text is, or null), line_licenses (sorted licences whose
    known text is a whole line) and n_notices (lines matched).

    ``known``: (digest, license) and, to spare lines of other lengths their digest,
    length of the canonical form. Of licences with the same digest the first is taken."""
    known = known_digests(spark) if known is None else known
    possible = None
    if "length" in known.columns:
        found = known.select(F.pmod("length", F.lit(_LENGTHS)).alias("l")).distinct().collect()  # at most _LENGTHS rows
        if all(r["l"] is not None for r in found):
            possible = sorted(r["l"] for r in found)
    known = known.groupBy("digest").agg(F.min("license").alias("license"))

    def wanted(e: Column) -> Column:
        written = e["form"] != ""
        return written if possible is None else written & F.pmod(F.length(e["form"]), F.lit(_LENGTHS)).isin(possible)

    base = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    base = base.select("id", F.xxhash64("text").alias("key"), canonical_lines(F.col("text")).alias("c"))
    lines = F.filter(F.transform("c", lambda x: F.struct(F.lit(False).alias("whole"), x.alias("form"))), wanted)
    forms = F.concat(F.array(F.struct(F.lit(True).alias("whole"), whole_form(F.col("c")).alias("form"))), lines)
    rows = base.select("id", "key", F.explode(forms).alias("e")).select(
        "id", "key", "e.whole", hex_digest(F.col("e.form")).alias("digest"))
    hits = rows.join(sized_broadcast(known), "digest", "left")
    line_hit = ~F.col("whole") & F.col("license").isNotNull()
    # rows equal in id and text are counted together and given back by their number
    out = hits.groupBy("id", "key").agg(
        F.count_if("whole").alias("n_rows"), F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("license"))).alias("license"),
        F.sort_array(F.collect_set(F.when(line_hit, F.col("license")))).alias("line_licenses"),
        F.count_if(line_hit).alias("n_hits"))
    out = out.select("*", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))))
    return out.select(F.col("id").alias(id_col), "digest", "license", "line_licenses",
                      (F.col("n_hits") / F.col("n_rows")).cast("long").alias("n_notices"))
