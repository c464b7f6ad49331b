"""Thresholds, weights and other fixed values of the engine, passed to jobs as parameters."""

from __future__ import annotations

from dataclasses import dataclass

#: Hypotheses as (name, target language, source language or None, order).
HYPOTHESES = (
    ("ru", "ru", None, 0),
    ("en", "en", None, 1),
    ("he", "he", None, 2),
    ("ru_from_en", "ru", "en", 3),
    ("he_from_en", "he", "en", 4),
    ("en_from_ru", "en", "ru", 5),
    ("en_from_he", "en", "he", 6),
    ("he_from_ru", "he", "ru", 7),
    ("ru_from_he", "ru", "he", 8),
)
CORRECTIONS = tuple(h for h in HYPOTHESES if h[2])

#: Letters of each language as a regular-expression class, lower case.
LETTERS = {
    "en": "a-z",
    "fr": "a-zàâæçéèêëîïôœùûüÿ",
    "de": "a-zäöüß",
    "es": "a-záéíñóúü",
    "ru": "а-яё",
    "he": "֐-׿",
}
#: Scripts as regular-expression classes.
SCRIPTS = {"en": "A-Za-zÀ-ɏ", "ru": "Ѐ-ԯ", "he": "֐-׿"}

#: Delimiters peeled from tokens, sentence ends, extensions of file names, one-letter words of Russian by English key.
LEADING = "([{\"«“"
BOUNDARY = ".!?:)]}\"»”…"
SENTENCE_END = ".!?"
EXTENSIONS = (
    "md", "txt", "rtf", "pdf", "json", "yaml", "yml", "toml", "ini", "conf", "plist", "xml", "csv", "log",
    "swift", "m", "mm", "c", "h", "cpp", "hpp", "cc", "hh", "rs", "go", "java", "kt", "py", "js", "ts", "tsx", "jsx", "html", "css", "scss",
    "zip", "gz", "bz2", "xz", "7z", "dmg", "pkg", "app",
)
PREPOSITIONS = {"f": "а", "d": "в", "r": "к", "j": "о", "e": "у", "b": "и", "z": "я"}


@dataclass(frozen=True)
class Thresholds:
    correction: float = 0.45
    deep_min: float = 0.7
    target_word_min: float = 0.80
    target_word_margin: float = 0.20
    target_freq_margin: float = 0.25
    target_norm_min: float = 0.75
    target_norm_margin: float = 0.15
    short_word_margin: float = 0.25
    long_word_margin: float = 0.70
    word_confidence_min: float = 0.80
    source_word_conf_max: float = 0.80
    base_conf_min: float = 0.75
    pending_timeout: float = 5.0
    pending_min: float = 0.40
    context_boost: float = 0.20
    buffer_gap: float = 2.0
    fast_path: float = 0.95
    standard_path: float = 0.70
    history: int = 50


DEFAULT = Thresholds()
