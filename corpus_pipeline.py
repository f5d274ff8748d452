"""From raw documents to a sharded training corpus, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; all but the last give the
columns of ``documents``.
"""

from rankloom.llm import decontaminate, mixing, quality, sharding, simhash
from rankloom.llm.common import DOCUMENT, documents
from rankloom.operators.sizing import stored
from rankloom.session import ship_package

#: Shingle length and maximum bit distance of the near-duplicate stage.
SHINGLE, MAX_BITS = 4, 4


def good_quality(spark, docs, sf_dir):
    """Documents that the quality classifier keeps, learned from ``labels``."""
    ship_package(spark)
    return quality.kept(docs.select(*DOCUMENT), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark, docs, sf_dir):
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    ship_package(spark)
    return simhash.one_of_each(docs.select(*DOCUMENT), SHINGLE, MAX_BITS)


def decontaminated(spark, docs, sf_dir):
    """Documents without a benchmark item."""
    ship_package(spark)
    return decontaminate.clean(docs.select(*DOCUMENT), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark, docs, sf_dir):
    """Documents as often as the mix of sources takes them."""
    ship_package(spark)
    return mixing.mixed(docs.select(*DOCUMENT))


def sharded(spark, docs, sf_dir):
    """Documents with their slot and shard."""
    ship_package(spark)
    return sharding.place(docs.select(*DOCUMENT), "doc_id")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_copies),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The classifier and the 64-bit hashes of the fingerprints have no form in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the table ``documents``; each stage's result is written and read again."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
