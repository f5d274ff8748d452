"""Table schemas and the fixed values that files must carry."""

from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())

CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("dense_embedding", VECTOR),
    ]
)

TOKENS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType(), False),
        T.StructField("embedding_id", T.IntegerType(), False),
        T.StructField("embedding", VECTOR),
    ]
)

QRELS = T.StructType(
    [
        T.StructField("query_id", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("rel", T.IntegerType()),
    ]
)

# ---- fixed values -------------------------------------------------------
# File formats: JSON member names and benchmark-log line starts.
DOC_TITLE = "title"
PART_TEXT = "content"
PART_DENSE = "embedding"
PART_TOKENS = "colbert_embedding"
LOG_HEADER = "ANN,COLBERT:"
LOG_TIME = "Time:"
LOG_ACCURACY = "NDCG@10:"

# Search defaults.
MAX_FETCH = 1000
SWEEP_VALUES = (20, 40, 80, 160, 240, 320)
EVAL_CUTS = (1, 3, 5, 10, 100)
MRR_CUTS = (1, 10, 100)
QUERY_CAP = 100
FILE_CAP = 1000
DENSE_BATCH = 32
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25
# -------------------------------------------------------------------------
