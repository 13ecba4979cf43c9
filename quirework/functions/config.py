"""Settings, their bounds, and presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Names of strategies and formats. ``grouping.register`` adds strategies.
STRATEGIES = ["fixed", "heading", "toc", "hybrid"]
FORMATS = ("json", "markdown", "summary", "search-index")


def _bounds(name: str, value: float, low: float, high: float | None = None) -> None:
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high is not None else ""))


@dataclass(frozen=True)
class Grouping:
    strategy: str = "hybrid"
    pages_per_group: int = 10
    heading_levels: tuple[int, ...] = (1, 2)
    min_size: int = 1
    max_size: int = 50

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {self.strategy}")
        for level in self.heading_levels:
            _bounds("heading level", level, 1, 6)
        for name in ("pages_per_group", "min_size", "max_size"):
            _bounds(name, getattr(self, name), 1)


@dataclass(frozen=True)
class Parsing:
    """What lines are told apart, and patterns of headings that replace the built-in ones."""

    headings: bool = True
    lists: bool = True
    tables: bool = True
    patterns: tuple[str, ...] = ()


# The prompt of an extraction, and what may be done with a model's reply.
EXTRACTION_PROMPT = "Extract structured information from this document section."
MODES = ("model", "enhance")


@dataclass(frozen=True)
class Extraction:
    """``mode``, where a model is called: its reply is the result (model), or goes over what the patterns found (enhance)."""

    entities: bool = True
    sections: bool = True
    tables: bool = True
    summary: bool = True
    prompt: str = EXTRACTION_PROMPT
    schema: str | None = None
    mode: str = "model"

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"unknown mode: {self.mode}")


@dataclass(frozen=True)
class Merging:
    deduplicate: bool = True
    merge_sections: bool = True
    summary_limit: int = 1000
    sort_entities: bool = True

    def __post_init__(self):
        _bounds("summary_limit", self.summary_limit, 1)


@dataclass(frozen=True)
class Output:
    format: str = "json"
    include_metadata: bool = True
    pretty: bool = True

    def __post_init__(self):
        if self.format not in FORMATS:
            raise ValueError(f"unknown format: {self.format}")


@dataclass(frozen=True)
class Execution:
    max_concurrency: int = 4
    retries: int = 3
    retry_delay_ms: int = 1000
    timeout_ms: int = 60000
    continue_on_error: bool = True
    #: Folder of replies that outlives a run: a prompt that has a reply there isn't sent again.
    replies: str | None = None

    def __post_init__(self):
        _bounds("max_concurrency", self.max_concurrency, 1, 20)
        _bounds("retries", self.retries, 0, 10)
        _bounds("retry_delay_ms", self.retry_delay_ms, 100)
        _bounds("timeout_ms", self.timeout_ms, 5000)


@dataclass(frozen=True)
class Settings:
    parsing: Parsing = field(default_factory=Parsing)
    grouping: Grouping = field(default_factory=Grouping)
    extraction: Extraction = field(default_factory=Extraction)
    merging: Merging = field(default_factory=Merging)
    output: Output = field(default_factory=Output)
    execution: Execution = field(default_factory=Execution)

    def with_(self, **parts: dict) -> Settings:
        """Overrides by part: ``with_(grouping={"strategy": "fixed"})``."""
        return replace(self, **{name: replace(getattr(self, name), **values) for name, values in parts.items()})


# Presets of settings and of flows.
PRESETS = {
    "fast": Settings().with_(execution={"max_concurrency": 8, "retries": 1, "timeout_ms": 30000, "retry_delay_ms": 500}),
    "thorough": Settings().with_(execution={"max_concurrency": 2, "retries": 5, "timeout_ms": 120000, "retry_delay_ms": 2000, "continue_on_error": False}),
    "largeDocument": Settings().with_(grouping={"strategy": "fixed", "pages_per_group": 20}, execution={"max_concurrency": 6, "timeout_ms": 90000}),
    "structured": Settings().with_(grouping={"strategy": "heading", "heading_levels": (1, 2, 3), "min_size": 2}, output={"format": "markdown"}),
    "searchIndex": Settings().with_(grouping={"pages_per_group": 5}, output={"format": "search-index", "pretty": False}),
}
FLOW_PRESETS = {
    "document": ("hybrid", None),
    "report": ("heading", "Extract key findings, metrics, and recommendations from this report section."),
    "invoice": ("fixed", "Extract invoice details: vendor, amounts, line items, dates, and payment terms."),
    "research": ("heading", "Extract research methodology, findings, data points, and citations."),
    "book": ("toc", "Extract chapter content, key concepts, and important passages."),
    "manual": ("heading", "Extract procedures, steps, warnings, and technical specifications."),
}


@dataclass(frozen=True)
class Flow:
    name: str
    strategy: str = "hybrid"
    prompt: str | None = None


def flow(preset: str, **overrides) -> Flow:
    strategy, prompt = FLOW_PRESETS[preset]
    return replace(Flow(preset, strategy, prompt), **overrides)
