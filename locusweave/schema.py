"""Column contracts shared by all operators."""

from pyspark.sql import types as T

CIGAR_TYPE = T.ArrayType(
    T.StructType([T.StructField("op", T.StringType()), T.StructField("len", T.IntegerType())])
)

#: One row per alignment record; a multi-mapping read has several rows.
ALIGNMENT_SCHEMA = T.StructType(
    [
        T.StructField("read_id", T.StringType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", CIGAR_TYPE),
        T.StructField("seq", T.StringType()),
        T.StructField("np", T.IntegerType()),
        T.StructField("nm", T.IntegerType()),
        T.StructField("rq", T.DoubleType()),
        T.StructField("cm", T.IntegerType()),
        T.StructField("de", T.DoubleType()),
        T.StructField("as_score", T.IntegerType()),
        T.StructField("rl", T.IntegerType()),
    ]
)

#: Seed intervals; ``seed_ord`` is the position in the merged seed list.
SEED_SCHEMA = T.StructType(
    [
        T.StructField("seed_ord", T.LongType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("name", T.StringType()),
    ]
)

# SAM flag bits (fixed values of the SAM format).
FLAG_UNMAPPED = 0x4
FLAG_REVERSE = 0x10
FLAG_SECONDARY = 0x100
FLAG_SUPPLEMENTARY = 0x800
