"""The registered queries of this package: each applies its operator to a whole table."""

from pyspark.sql import functions as F

from rankloom.llm import (
    decontaminate,
    langid,
    lm,
    merkle,
    minhash,
    mixing,
    passages,
    pieces,
    pii,
    quality,
    sharding,
    simhash,
    spelling,
)
from rankloom.llm.common import documents


def op1_pii(spark, sf_dir):
    return pii.personal_data(documents(spark, sf_dir))


def op2_passages(spark, sf_dir):
    return passages.repeated(documents(spark, sf_dir))


def op3_lm(spark, sf_dir):
    return lm.score(documents(spark, sf_dir))


def op4_minhash(spark, sf_dir):
    return minhash.fingerprinted(documents(spark, sf_dir))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_sharding(spark, sf_dir):
    return sharding.place(documents(spark, sf_dir).select("doc_id"), "doc_id")


def op7_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir)).drop("source")


def op8_langid(spark, sf_dir):
    return langid.identify(documents(spark, sf_dir))


def op9_quality(spark, sf_dir):
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_simhash(spark, sf_dir):
    found = simhash.groups(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_pieces(spark, sf_dir):
    import public_tokenizers

    return pieces.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op12_merkle(spark, sf_dir):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return merkle.manifest(documents(spark, sf_dir), tampered=tampered).drop("lang", "witness")


def op13_spelling(spark, sf_dir):
    return spelling.variants(documents(spark, sf_dir))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_passages": op2_passages,
    "op3_lm": op3_lm,
    "op4_minhash": op4_minhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_langid": op8_langid,
    "op9_quality": op9_quality,
    "op10_simhash": op10_simhash,
    "op11_pieces": op11_pieces,
    "op12_merkle": op12_merkle,
    "op13_spelling": op13_spelling,
}

_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join(
    _FIELD.format(c) for c in ["doc_id::VARCHAR", "source", "lang", "{n_chars}::VARCHAR", "text"]
) + ")"
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda c, b: list_reduce(
        list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

#: Trees by recursion over levels; each leaf is then folded upwards, one level of its path at a time.
_MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(hex(lang), '-') AS g, {_LEAF.format(n_chars="n_chars")} AS leaf,
    CASE WHEN {_CRC32} % 7 = 0 THEN {_LEAF.format(n_chars="(n_chars + 1)")} END AS changed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY g) AS size
  FROM leaves),
nodes AS (
  SELECT g, 0 AS level, pos, size, leaf AS h FROM placed
  UNION ALL
  SELECT g, level + 1, pos // 2, any_value((size + 1) // 2), sha256(string_agg(h, '' ORDER BY pos))
  FROM nodes WHERE size > 1 GROUP BY g, level, pos // 2),
subroots AS (
  SELECT g, h AS subroot, row_number() OVER (ORDER BY g <> '-', g) - 1 AS pos, count(*) OVER () AS size
  FROM nodes WHERE size = 1),
tops AS (
  SELECT '' AS g, 0 AS level, pos, size, subroot AS h FROM subroots
  UNION ALL
  SELECT g, level + 1, pos // 2, any_value((size + 1) // 2), sha256(string_agg(h, '' ORDER BY pos))
  FROM tops WHERE size > 1 GROUP BY g, level, pos // 2),
folded AS (
  SELECT r, g, 0 AS level, pos, size, coalesce(changed, leaf) AS h, '' AS proof FROM placed
  UNION ALL
  SELECT f.r, f.g, f.level + 1, f.pos // 2, (f.size + 1) // 2,
    sha256(CASE WHEN f.pos % 2 = 1 THEN coalesce(n.h, '') || f.h ELSE f.h || coalesce(n.h, '') END),
    f.proof || coalesce(n.h, '')
  FROM folded f LEFT JOIN nodes n ON n.g = f.g AND n.level = f.level AND n.pos = xor(f.pos, 1)
  WHERE f.size > 1),
above AS (
  SELECT f.r, '' AS g, 0 AS level, s.pos, s.size, f.h, f.proof FROM folded f JOIN subroots s USING (g) WHERE f.size = 1
  UNION ALL
  SELECT f.r, f.g, f.level + 1, f.pos // 2, (f.size + 1) // 2,
    sha256(CASE WHEN f.pos % 2 = 1 THEN coalesce(n.h, '') || f.h ELSE f.h || coalesce(n.h, '') END),
    f.proof || coalesce(n.h, '')
  FROM above f LEFT JOIN tops n ON n.level = f.level AND n.pos = xor(f.pos, 1)
  WHERE f.size > 1)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(a.proof) AS proof_sha256, a.h AS folded_root, a.h = t.h AS verified
FROM placed p JOIN subroots s USING (g) JOIN above a USING (r) JOIN tops t ON t.size = 1
WHERE a.size = 1"""

CHECKS = {"op12_merkle": _MERKLE}

#: Queries that SQL cannot state, with the tests that hold them against brute force, a round trip or held-out accuracy.
TESTED = {
    "op1_pii": ["test_methods.py::test_pii_base", "test_methods.py::test_pii_discovers", "test_methods.py::test_pii_unknown_identifiers"],
    "op2_passages": ["test_methods.py::test_passages", "test_methods.py::test_passages_have_all_their_links", "test_methods.py::test_passages_of_a_large_group", "test_methods.py::test_compact_windows"],
    "op3_lm": ["test_methods.py::test_lm", "test_methods.py::test_lm_normalised", "test_methods.py::test_lm_learns"],
    "op4_minhash": ["test_methods.py::test_minhash", "test_methods.py::test_near_duplicates", "test_methods.py::test_near_duplicates_of_a_table"],
    "op5_decontaminate": ["test_decontaminate.py::test_against_brute_force", "test_methods.py::test_decontaminate"],
    "op6_sharding": ["test_methods.py::test_sharding"],
    "op7_mixing": ["test_methods.py::test_mixing"],
    "op8_langid": ["test_methods.py::test_langid", "test_methods.py::test_langid_bundle"],
    "op9_quality": ["test_methods.py::test_quality", "test_methods.py::test_site_rates"],
    "op10_simhash": ["test_methods.py::test_simhash_links", "test_methods.py::test_simhash_fingerprint"],
    "op11_pieces": ["test_pieces.py::test_whole_table", "test_pieces.py::test_digests"],
    "op13_spelling": ["test_spelling.py::test_whole_table", "test_spelling.py::test_made_up_texts"],
    "pipeline": ["test_edges.py::test_pipeline_on_edges"],
}
