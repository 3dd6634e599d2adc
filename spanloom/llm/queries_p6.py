"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scans import line_facts, misread_lines, page_lines, repaired, repairs, scanned_contracts, sign_repairs, split_words, vocabulary
from .shared import kept, table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of scanned contracts that are page furniture, end in a cut word, or hold a misread character."""
    contracts = table(spark, sf_dir, "cuadv1").select("title", "doc_text")
    lexicon = vocabulary(contracts)
    scanned = scanned_contracts(contracts)
    pages = kept(page_lines(scanned))
    facts = line_facts(scanned, pages)
    split = kept(split_words(facts, lexicon))
    parts = {"page_line": pages, "split_word": split, "misread": misread_lines(facts, repairs(facts, lexicon), sign_repairs(facts, lexicon), split)}
    out = None
    for kind, rows in parts.items():
        own = rows.select("title", "line_no", F.lit(kind).alias("kind"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def p6_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned contracts as continuous, repaired paragraphs."""
    contracts = table(spark, sf_dir, "cuadv1").select("title", "doc_text").filter("doc_text <> ''")
    lexicon = vocabulary(contracts)
    scanned = scanned_contracts(contracts)
    pages = kept(page_lines(scanned))
    facts = line_facts(scanned, pages)
    return repaired(scanned, pages, kept(split_words(facts, lexicon)), facts, repairs(facts, lexicon), sign_repairs(facts, lexicon))


QUERIES = {"p6_found": p6_found, "p6_paragraphs": p6_paragraphs}
