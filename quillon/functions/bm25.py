"""BM25 weights as column expressions, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring function, and the least inverse document frequency.
B, K1, LEAST_IDF = 0.5, 1.2, 1e-6


def doc_term_weight(freq: Column, norm_len: Column) -> Column:
    return freq / (freq + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * norm_len))


def query_term_weight(qtf: Column, df: Column, num_docs: Column) -> Column:
    idf = F.log((num_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))
    return qtf * F.greatest(F.lit(LEAST_IDF), idf) * F.lit(1 + K1)
