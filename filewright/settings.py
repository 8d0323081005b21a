"""Parameters of a run. Plain values, passed into the DataFrame functions."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from typing import NamedTuple


class Rule(NamedTuple):
    """A pattern over the lower-cased file name and text head, and its verdict.

    A pattern is matched against the name and against the head of the text
    separately, so it must not be written to span both.
    """

    pattern: str
    category_l1: str
    category_l2: str
    confidence: float
    reason: str


# The default rules, in order of precedence.
DEFAULT_RULES = (
    Rule(r"invoice|receipt|bill|nota fiscal|boleto", "Finance", "Invoices", 0.92, "Matched finance rule"),
    Rule(r"resume|curriculum|cv\b", "Career", "Resumes", 0.95, "Matched resume rule"),
    Rule(r"slide|presentation|deck", "Knowledge", "Presentations", 0.88, "Matched presentation rule"),
    Rule(r"\.py\b|def |class |import ", "Engineering", "Code", 0.84, "Matched code rule"),
)

# Words that never count as keywords.
STOP_WORDS = ("this", "that", "with", "from", "have", "your", "para", "como", "mais", "will", "they")

# Folder names that are not categories.
DUPLICATES = "_Duplicates"
NEEDS_REVIEW = "_NeedsReview"
UNSUPPORTED = "_Unsupported"
FAILED_EXTRACTION = "_FailedExtraction"
UNPROCESSED = "_Unprocessed"
IGNORED = "_Ignored"
TECHNICAL_FOLDERS = (NEEDS_REVIEW, UNSUPPORTED, DUPLICATES, FAILED_EXTRACTION)


@dataclass(frozen=True)
class Settings:
    # The defaults up to the aliases.
    organized_dir: str = "/organized"
    ignore_dirs: tuple[str, ...] = (UNPROCESSED, IGNORED)
    technical_folders: tuple[str, ...] = TECHNICAL_FOLDERS
    max_content_length: int = 40_000
    prompt_version: str = "v3"
    understanding_model: str = "qwen3.5:4b"
    classification_model: str = "qwen3.5:4b"
    ocr_model: str | None = "glm-ocr:q8_0"
    review_confidence: float = 0.55
    level1_default: str = "General"
    level2_default: str = "Unsorted"
    aliases: Mapping[str, str] = field(default_factory=dict)
    level1_aliases: Mapping[str, str] = field(default_factory=dict)
    level2_aliases: Mapping[str, str] = field(default_factory=dict)
    rules: tuple[Rule, ...] = DEFAULT_RULES
    stop_words: tuple[str, ...] = STOP_WORDS
    # A decision-cache hit carries no text. True sends such rows to the
    # failed-extraction folder, False keeps their cached category.
    strict_cache_routing: bool = False
    # True reads "False", "no" and "0" in a model answer as false. By default
    # every non-empty string is true.
    parse_bool_strings: bool = False
    # How many folders a prompt names, and how many subfolders of each.
    prompt_folders: int = 1_000
    # A key with more rows than this is split over several tasks.
    hot_rows: int = 1_000_000

    @property
    def ocr_key(self) -> str:
        return self.ocr_model or "none"


class Run(NamedTuple):
    """One run over the inbox. The time is passed in so that reruns agree."""

    run_id: str
    started_at: datetime
    dry_run: bool = False
