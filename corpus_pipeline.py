"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A stage that can't be expressed in SQL (forest, chosen paths, raking by
float iteration) makes ORACLE_SQL None; tests hold run() against a brute-force version.

Line dedup can leave a document without a word, when all its lines stand earlier elsewhere:
such a document holds nothing more and goes.
"""

from __future__ import annotations

from ontolith.llm import decontam, linededup, mixing, ngramjoin, quality
from ontolith.llm.util import cut, release, table


def quality_rules(spark, docs, sf_dir):
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    return linededup.tidy(docs)


def ngram_join(spark, docs, sf_dir):
    return ngramjoin.thin(docs)


def decontamination(spark, docs, sf_dir):
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if last is not None:
            release(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
