"""Evaluation files: strict contracts, fingerprints and baselines."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any

from ..operators.gates import Baseline, ContractError, GatePolicy, MetricGate, policy_errors
from .storage import write_whole


@dataclass(frozen=True)
class Case:
    id: str
    tags: tuple[str, ...]
    critical: bool
    question: str
    expected_arm: str
    scope: dict[str, int]
    gold_chunks: tuple[int, ...] | None
    gold_segments: tuple[tuple[float, float], ...] | None
    required_claims: tuple[str, ...] = ()


@dataclass(frozen=True)
class Source:
    start: float
    end: float
    chunk_id: int | None = None
    level: str = "leaf"
    child_chunk_ids: tuple[int, ...] = ()
    episode_id: int | None = None
    text: str | None = None


@dataclass(frozen=True)
class Observation:
    case_id: str
    arm: str
    answer_text: str
    sources: tuple[Source, ...]
    error: str | None = None
    duration_ms: int | None = None


@dataclass(frozen=True)
class Bundle:
    """The observations of a run, and what they are of."""

    dataset_fingerprint: str
    provenance: str
    observations: tuple[Observation, ...]


def fingerprint(dataset: Any) -> str:
    """sha256 of the canonical JSON: sorted keys, no spaces, no escapes."""
    plain = json.dumps(dataset, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(plain.encode()).hexdigest()


def read_json(path: str | Path) -> Any:
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ContractError(f"{path}: {e}") from e


def strict(kind: type, given: dict) -> dict:
    """``given`` if all of its keys are fields of ``kind``."""
    if extra := sorted(set(given) - {f.name for f in fields(kind)}):
        raise ContractError(f"{kind.__name__}: unknown keys {extra}")
    return given


def load_case(given: dict) -> Case:
    g = {k: v for k, v in given.items() if k not in ("reference_answer", "conflicts")}
    strict(Case, g)
    segments = g.get("gold_segments")
    return Case(**g | {
        "tags": tuple(g["tags"]), "gold_chunks": None if g["gold_chunks"] is None else tuple(g["gold_chunks"]),
        "gold_segments": None if segments is None else tuple((s["start"], s["end"]) for s in segments),
        "required_claims": tuple(g.get("required_claims") or ())})


def case_errors(cases: list[Case]) -> list[str]:
    """Breaches of the rules that tie golds, arms and tags together."""
    out = [] if cases else ["dataset must contain at least one case"]
    seen: set[str] = set()
    for c in cases:
        said = []
        if c.id in seen:
            said.append("duplicate id")
        seen.add(c.id)
        if "no_knowledge" in c.tags:
            if c.gold_chunks is not None or c.gold_segments is not None:
                said.append("no_knowledge case must have both golds null")
            if c.required_claims:
                said.append("no_knowledge case must have empty required_claims")
        elif c.expected_arm == "full-context":
            if c.gold_chunks is not None or not c.gold_segments:
                said.append("full-context needs gold_chunks=null and non-empty gold_segments")
        elif not c.gold_chunks or c.gold_segments is not None:
            said.append("search needs non-empty gold_chunks and gold_segments=null")
        if "cross_podcast" in c.tags and c.scope:
            said.append("cross_podcast case must use empty scope (whole library)")
        said += ["gold_segment start > end" for a, b in c.gold_segments or () if a > b]
        out += [f"{c.id}: {s}" for s in said]
    return out


def load_dataset(path: str | Path) -> tuple[list[Case], str]:
    """Cases and fingerprint; ContractError for any breach."""
    raw = read_json(path)
    cases = [load_case(c) for c in raw["cases"]]
    if errors := case_errors(cases):
        raise ContractError("; ".join(errors))
    return cases, fingerprint(raw)


def load_bundle(path: str | Path) -> Bundle:
    """Observations from a file, strictly: unknown keys and other arms or origins are errors."""
    raw = read_json(path)
    try:
        strict(Bundle, raw)
        observations = []
        for o in raw["observations"]:
            sources = tuple(Source(**strict(Source, s) | {"child_chunk_ids": tuple(s.get("child_chunk_ids") or ())}) for s in strict(Observation, o)["sources"])
            observations.append(Observation(**o | {"sources": sources}))
        bundle = Bundle(**raw | {"observations": tuple(observations)})
    except (KeyError, TypeError, AttributeError) as e:
        raise ContractError(f"{path}: {e}") from e
    if bundle.provenance not in ("contract_smoke", "live") or any(o.arm not in ("full-context", "search") for o in bundle.observations):
        raise ContractError(f"{path}: unknown provenance or arm")
    return bundle


def save_bundle(path: Path, bundle: Bundle) -> None:
    write_whole(Path(path), json.dumps(asdict(bundle), ensure_ascii=False, indent=2) + "\n")


def gold_problems(cases: list[Case], chunks: dict[int, tuple[int, int]], spans: dict[int, set[tuple[float, float]]]) -> dict[str, tuple[list[str], list[str]]]:
    """Of each case, problems (gold chunks that don't exist; gold segments that aren't, to the very times, among the
    cleaned segments of its episode) and warnings (gold chunks outside the scope). ``chunks``: id to episode and
    podcast; ``spans``: episode to the (start, end) of its segments."""
    out = {}
    for c in cases:
        problems, warnings = [], []
        for g in c.gold_chunks or ():
            if g not in chunks:
                problems.append(f"chunk {g} not found")
                continue
            for name, own in zip(("episode_id", "podcast_id"), chunks[g], strict=True):
                if name in c.scope and c.scope[name] != own:
                    warnings.append(f"chunk {g} is in {name.removesuffix('_id')} {own}, outside scope")
        episode = c.scope.get("episode_id")
        problems += [f"segment [{a}, {b}] not in episode {episode}" for a, b in c.gold_segments or () if (a, b) not in spans.get(episode, set())]
        out[c.id] = (problems, warnings)
    return out


def load_policy(path: str | Path) -> GatePolicy:
    raw = strict(GatePolicy, read_json(path))
    policy = GatePolicy(raw["k"], tuple(MetricGate(**strict(MetricGate, g)) for g in raw["metric_gates"]), raw["critical_no_regression"], tuple(raw["required_provenance"]))
    if errors := policy_errors(policy):
        raise ContractError("; ".join(errors))
    return policy


def load_baseline(path: str | Path) -> Baseline | None:
    """None where there is no file."""
    if not Path(path).exists():
        return None
    raw = {k: v for k, v in read_json(path).items() if k != "created_at"}
    return Baseline(**strict(Baseline, raw))


def save_baseline(path: Path, dataset: str, k: int, provenance: str, metrics: dict[str, tuple[float, int]], passed: dict[str, bool], created_at: str) -> None:
    """Deterministic metrics only; judges' scores never become a baseline."""
    plain = {m: v for m, v in metrics.items() if not m.startswith("judge_")}
    write_whole(Path(path), json.dumps({
        "dataset_fingerprint": dataset, "k": k, "provenance": provenance, "metrics": {m: v[0] for m, v in sorted(plain.items())},
        "eligible_cases": {m: v[1] for m, v in sorted(plain.items())}, "case_passed": dict(sorted(passed.items())), "created_at": created_at,
    }, ensure_ascii=False, indent=2) + "\n")
