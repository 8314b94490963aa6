"""Options of segmentation: validation and defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from ..sources.languages import LANGUAGES, Language

FIRST_SENTENCE, FIRST_TEN, PER_SENTENCE, FULL_TEXT = "first_sentence", "first_ten_sentences", "per_sentence", "full_text"
DISABLE, FORCE, ADAPTIVE = "disable", "force", "adaptive"


@dataclass
class SegmentOptions:
    """max_tokens is required. None for a switch means on."""

    max_tokens: int
    min_split_similarity: float = 0.0
    depth_threshold: float = 0.0
    language: str = ""
    language_detection_mode: str = ""
    language_detection_tokens: int = 0
    pre_normalize_abbreviations: bool | None = None
    enable_stop_word_removal: bool | None = None
    enable_stemming: bool | None = None
    tfidf_min_ngram_size: int = 0
    tfidf_max_ngram_size: int = 0
    embedding_cache_mode: str = ""
    embedding_cache: object | None = field(default=None, repr=False)
    cache_similarity_threshold: float = 0.0
    adaptive_cache_activation_threshold: int = 0
    languages: dict[str, Language] = field(default_factory=lambda: LANGUAGES, repr=False)

    def __post_init__(self):
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be a positive number")
        if self.embedding_cache_mode not in ("", DISABLE) and self.embedding_cache is None:
            raise ValueError("embedding_cache must be provided when a cache mode is enabled")
        self.embedding_cache_mode = self.embedding_cache_mode or DISABLE
        if self.min_split_similarity == 0 and self.depth_threshold < 0:
            self.depth_threshold = 0.1
        if not self.language and not self.language_detection_mode:
            self.language_detection_mode = FIRST_SENTENCE
        if self.embedding_cache_mode != DISABLE and self.cache_similarity_threshold == 0:
            self.cache_similarity_threshold = 0.9
        if self.embedding_cache_mode == ADAPTIVE and self.adaptive_cache_activation_threshold == 0:
            self.adaptive_cache_activation_threshold = 100
        for name in ("pre_normalize_abbreviations", "enable_stop_word_removal", "enable_stemming"):
            if getattr(self, name) is None:
                setattr(self, name, True)

    @property
    def ngrams(self) -> bool:
        return 0 < self.tfidf_min_ngram_size <= self.tfidf_max_ngram_size

    def as_row(self) -> dict:
        """The options really used."""
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("embedding_cache", "languages")}
