"""Engine parameters: one frozen dataclass, range-checked eagerly on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Fixed values that must equal the service being re-implemented (defaults and ranges
# of its configuration, and the labels of the product text format).
DEFAULT_TOP_K = 5            # range 1..100
MAX_TOP_K = 50               # range 1..1000
SCORE_DECIMAL_PLACES = 4     # range 0..10
VECTOR_DIM = 384             # range 1..4096 (the embedder's own dim wins)
EMBEDDING_BATCH_SIZE = 32    # range 1..512
MAX_TEXT_LENGTH = 512        # tokens, range 1..8192
MIN_CLAMP_VALUE = 1e-9       # > 0
MODEL_NAME = "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"
MIN_TEXT_CHARS = 1
MAX_TEXT_CHARS = 100000
DESCRIPTION_CAP = 2000
ATTRIBUTE_CAP = 10
FAILURE_SAMPLE = 10
LOAD_BATCH_SIZE = 100
SEARCH_RUN_SIZE = 1000
SEARCH_RUN_K = 5

# Product text labels and separators, in output order.
LABEL_TITLE = "Название: "
LABEL_CATEGORIES = "Категории: "
LABEL_DESCRIPTION = "Описание: "
LABEL_ATTRIBUTES = "Характеристики: "
LABEL_SELLER = "Продавец: "
LABEL_RATING = "Рейтинг: "
PART_SEPARATOR = " | "
CATEGORY_SEPARATOR = " > "
ATTRIBUTE_SEPARATOR = "; "


def _check(name: str, value, lo=None, hi=None, gt=None) -> None:
    if lo is not None and value < lo:
        raise ValueError(f"{name} must be >= {lo}, got {value}")
    if hi is not None and value > hi:
        raise ValueError(f"{name} must be <= {hi}, got {value}")
    if gt is not None and not value > gt:
        raise ValueError(f"{name} must be > {gt}, got {value}")


@dataclass(frozen=True)
class Params:
    default_top_k: int = DEFAULT_TOP_K
    max_top_k: int = MAX_TOP_K
    score_decimal_places: int = SCORE_DECIMAL_PLACES
    vector_dim: int = VECTOR_DIM
    embedding_batch_size: int = EMBEDDING_BATCH_SIZE
    max_text_length: int = MAX_TEXT_LENGTH
    min_clamp_value: float = MIN_CLAMP_VALUE
    model_name: str = MODEL_NAME
    description_cap: int = DESCRIPTION_CAP
    attribute_cap: int = ATTRIBUTE_CAP
    failure_sample: int = FAILURE_SAMPLE
    load_batch_size: int = LOAD_BATCH_SIZE
    labels: tuple = field(default=(LABEL_TITLE, LABEL_CATEGORIES, LABEL_DESCRIPTION,
                                   LABEL_ATTRIBUTES, LABEL_SELLER, LABEL_RATING))
    # Largest query matrix (rows * dim * 8 bytes) shipped to executors as a broadcast;
    # above it the similarity join runs block x block through a shuffle.
    broadcast_query_bytes: int = 64 << 20

    def __post_init__(self) -> None:
        _check("default_top_k", self.default_top_k, 1, 100)
        _check("max_top_k", self.max_top_k, 1, 1000)
        _check("score_decimal_places", self.score_decimal_places, 0, 10)
        _check("vector_dim", self.vector_dim, 1, 4096)
        _check("embedding_batch_size", self.embedding_batch_size, 1, 512)
        _check("max_text_length", self.max_text_length, 1, 8192)
        _check("min_clamp_value", self.min_clamp_value, gt=0)
        _check("description_cap", self.description_cap, 1)
        _check("attribute_cap", self.attribute_cap, 1)
        _check("failure_sample", self.failure_sample, 0)
        _check("load_batch_size", self.load_batch_size, 1)
        _check("broadcast_query_bytes", self.broadcast_query_bytes, 0)
        if len(self.labels) != 6:
            raise ValueError("labels must hold six entries")

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)


DEFAULT = Params()
