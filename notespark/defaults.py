"""Default parameters (fixed values)."""

RRF_K = 60.0
EMBEDDING_WEIGHT = 1.5
TERM_BOOST = 0.05
TERM_BOOST_CAP = 0.5
TOP_K = 5
OVER_FETCH_FACTOR, OVER_FETCH_CAP = 3, 50
RERANK_POOL_FACTOR, RERANK_CANDIDATES, RERANK_MAX_SCORE = 4, 25, 10.0
SHORT_QUERY_WORDS, SHORT_QUERY_FACTOR = 3, 1.5
HYDE_WEIGHT, HYDE_MAX_WORDS, HYDE_LEAST_BYTES = 0.8, 4, 50
SYNONYM_WEIGHT = 0.6
REWRITTEN_WEIGHT = 0.9
SAME_LANGUAGE, OTHER_LANGUAGE = 1.5, 0.5
MIN_SCORE_MARGIN, MIN_SCORE_CEILING, MIN_SCORE_FLOOR, MIN_SCORE_FALLBACK = 0.9, 0.05, 0.001, 0.005
MIN_SCORE_LAST_RANK = 5
FUSION_CANDIDATES = 50
#: The calibration grid: weights of the vector list, k of the fusion, weights of the term boost.
GRID_WEIGHTS = (0.0, 0.2, 0.5, 0.8, 1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0)
GRID_KS = (10.0, 20.0, 40.0, 60.0, 80.0, 100.0)
GRID_BOOSTS = (0.0, 0.01, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3)
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
FRAGMENT_TOKENS = 256
CACHE_SECONDS = 30 * 86400
RETENTION = 0.9
LANGUAGE_SAMPLE, LANGUAGE_LEAST_BYTES = 50, 10

#: Fixed values of the published FSRS-6 scheduler.
FSRS_WEIGHTS = (
    0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835,
    0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542,
)
