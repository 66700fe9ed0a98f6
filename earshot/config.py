"""Settings and the fixed values that results depend on."""

from __future__ import annotations

import string
from dataclasses import dataclass, field

# Word lists, marks, formats and limits that results must agree with.
FILLERS_EN = ("um", "uh", "ah", "hmm", "erm", "er", "hm")
FILLERS_ZH = ("额", "呃", "噢", "嗯", "呢")
STRIPPED_MARKS = "，。！？；：、…“”‘’（）《》【】—～·"
STRIPPED = string.punctuation + string.whitespace + STRIPPED_MARKS
UNSPACED_LANGUAGES = ("zh", "ja")
AUDIO_EXTENSIONS = (".mp3", ".m4a", ".mp4", ".ogg", ".opus", ".wav", ".aac")
MIME_EXTENSIONS = {
    "audio/mpeg": ".mp3", "audio/mp3": ".mp3", "audio/mp4": ".m4a", "audio/x-m4a": ".m4a", "audio/ogg": ".ogg",
    "audio/opus": ".opus", "audio/wav": ".wav", "audio/x-wav": ".wav", "audio/aac": ".aac",
}
RETRIED_STATUSES = (429, 500, 502, 503, 504)
APPLE_HOSTS = ("podcasts.apple.com", "itunes.apple.com")
SENTENCE_MARKS = "。！？；.!?;"
FULL_WIDTH_MARKS = "，。？！、；：…"
HALF_WIDTH_MARKS = ",.?!;:"
SEGMENT_MARKS = "。？！.?!"
SNAP_SHARE = 0.15
FUZZY_SHARE = 0.7
MESSAGE_TOKENS = 4
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
CHINESE = ("zh",)
ZONE_HOURS = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}
#: Words that the English full-text configuration leaves out.
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
""".split())
METRIC_FLOORS = {"case_pass_rate": 0.5, "citation_hit": 0.5, "citation_precision": 0.5, "recall@{k}": 0.4, "precision@{k}": 0.4, "gold_chunk_coverage": 0.6}
MOST_FAILURES, MOST_REGRESSION, GATE_EPSILON = 0.3, 0.15, 1e-12


@dataclass(frozen=True)
class Bounds:
    """Limits of a leaf chunk or a parent; parents have no minimums."""

    desired_tokens: int
    max_tokens: int
    min_tokens: int = 0
    min_seconds: float = 0.0
    max_seconds: float = 360.0


@dataclass(frozen=True)
class Tier:
    """Leaf and parent bounds for episodes up to ``seconds`` long."""

    name: str
    seconds: float
    leaf: Bounds
    parent: Bounds


def _tier(name: str, seconds: float, leaf: tuple[int, int, int], parent: tuple[int, int]) -> Tier:
    least, wanted, most = leaf
    return Tier(name, seconds, Bounds(wanted, most, least, 10.0, 360.0), Bounds(*parent))


@dataclass(frozen=True)
class Settings:
    top_k: int = 5
    candidates: int = 3
    merge_threshold: int = 2
    score_mode: str = "distance"
    most_citations: int = 8
    context_tokens: int = 1_000_000
    reserved_tokens: int = 2_048
    embed_batch: int = 32
    poll_seconds: float = 10.0
    tiers: tuple[Tier, ...] = field(default_factory=lambda: (
        _tier("short", 900, (30, 45, 60), (300, 500)),
        _tier("medium", 2700, (60, 100, 150), (400, 650)),
        _tier("long", float("inf"), (150, 200, 250), (520, 800)),
    ))

    @property
    def input_budget(self) -> int:
        return self.context_tokens - self.reserved_tokens
