"""Parser and planner of path expressions such as ``scale(sumSeries(clusters.*.n_{1,2}.events.view), 2)``."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import graphite as registry
from ..functions.timeparse import parse_time
from ..operators.resample import resample, resample_dense
from ..operators.series import Series
from ..operators.timerange import TimeRange


@dataclass(frozen=True)
class Path:
    text: str


@dataclass(frozen=True)
class Apply:
    name: str
    args: tuple


_WORD = re.compile(r"(?:\{[^{}]*\}|[^,(){}\s'\"])+")


def parse(text: str) -> tuple[object, dict]:
    """(expression, options). Values are paths, strings in quotes, numbers, booleans and calls; options follow ``||``."""
    text, *tail = text.split("||")
    options = {k.strip(): v.strip() or True for t in tail for k, _, v in (x.partition("=") for x in t.split(",") if x.strip())}
    at = 0

    def blank() -> None:
        nonlocal at
        while at < len(text) and text[at].isspace():
            at += 1

    def value():
        nonlocal at
        blank()
        if at < len(text) and text[at] in "'\"":
            quote, out = text[at], []
            at += 1
            while at < len(text) and text[at] != quote:
                if text[at] == "\\" and at + 1 < len(text) and text[at + 1] in "'\"\\":
                    at += 1
                out.append(text[at])
                at += 1
            if at >= len(text):
                raise ValueError(f"unclosed quote in {text!r}")
            at += 1
            return "".join(out)
        m = _WORD.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        at, word = m.end(), m[0]
        blank()
        if at < len(text) and text[at] == "(":
            at += 1
            args = []
            blank()
            while at < len(text) and text[at] != ")":
                args.append(value())
                blank()
                if at < len(text) and text[at] == ",":
                    at += 1
                elif at >= len(text) or text[at] != ")":
                    raise ValueError(f"expected ',' or ')' at {text[at:]!r}")
                blank()
            if at >= len(text):
                raise ValueError(f"unclosed call in {text!r}")
            at += 1
            return Apply(word, tuple(args))
        if re.fullmatch(r"-?\d+", word):
            return int(word)
        if re.fullmatch(r"-?\d*\.\d+(?:[eE][+-]?\d+)?|-?\d+[eE][+-]?\d+", word):
            return float(word)
        if word.lower() in ("true", "false"):
            return word.lower() == "true"
        if word.lower() in ("none", "null"):
            return None
        return Path(word)

    out = value()
    blank()
    if at < len(text):
        raise ValueError(f"unexpected {text[at:]!r}")
    return out, options


def token_predicate(token: Column, pattern: str) -> Column:
    """``*`` any text, ``?`` a character, ``{a,b}`` or ``{a;b}`` alternatives; plain tokens compare equal."""
    if pattern == "*":
        return F.lit(True)
    if not re.search(r"[*?{\[]", pattern):
        return token == pattern
    m = re.fullmatch(r"\{([^{}*?\[]*)\}", pattern)
    if m:
        return token.isin(*re.split("[,;]", m[1]))
    return token.rlike("^" + glob(pattern) + "$")


def glob(pattern: str) -> str:
    """A glob as a regular expression."""
    out = []
    for part in re.split(r"(\{[^{}]*\}|\*|\?|\[[^\]]*\])", pattern):
        if part == "*":
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif part.startswith("{"):
            out.append("(?:" + "|".join(glob(x) for x in re.split("[,;]", part[1:-1])) + ")")
        elif part.startswith("["):
            out.append(part.replace("[!", "[^"))
        else:
            out.append(re.sub(r"([.^$+()|\\{}\[\]])", r"\\\1", part))
    return "".join(out)


def split_path(path: str) -> list[str]:
    """Tokens of a pattern; dots in braces do not separate."""
    return re.findall(r"(?:\{[^{}]*\}|[^.{}])+", path)


def path_predicate(path: str, name: Column) -> Column:
    """Whether a dotted name matches a pattern, token by token. A literal prefix becomes a range that scans can use."""
    tokens = split_path(path)
    parts = F.split(name, r"\.")
    fixed = []
    for t in tokens:
        if re.search(r"[*?{\[]", t):
            break
        fixed.append(t)
    out = name.startswith(".".join(fixed)) if fixed else F.lit(True)
    out = out & (F.size(parts) == len(tokens))
    for i, t in enumerate(tokens):
        if i >= len(fixed) and t != "*":
            out = out & token_predicate(F.get(parts, F.lit(i)), t)
        elif i < len(fixed):
            out = out & (F.get(parts, F.lit(i)) == t)
    return out


class GraphitePlanner:
    """Evaluates targets over points (name, epoch, value, optionally marker and version)."""

    def __init__(self, points: DataFrame, storage_interval: int = 60, sparse: bool = True, fixed: dict[str, int] | None = None):
        """``fixed``: patterns of names that are written at every step, and that step; they are not sparse."""
        self.points, self.storage, self.sparse, self.fixed = points, storage_interval, sparse, fixed or {}

    def interval(self, start: int, end: int, max_points: int | None, paths: list[str]) -> int:
        """The asked resolution, up to the storage step; fields with steps of their own must agree."""
        steps = {next((s for pattern, s in self.fixed.items() if re.fullmatch(glob(pattern), p)), self.storage) for p in paths}
        if len(steps) > 1:
            raise ValueError("paths with different storage steps")
        step = steps.pop() if steps else self.storage
        wanted = (end - start) // (max_points or max(1, -(-(end - start) // 600)))
        return max(step, -(-wanted // step) * step)

    def render(self, target: str, start, end, max_points: int | None = None, now: int | None = None) -> Series:
        tree, options = parse(target)
        start, end = parse_time(start, now), parse_time(end, now)
        rng = TimeRange(start, end, self.interval(start, end, max_points, paths_of(tree))).aligned()
        wider = TimeRange(rng.start - rng.interval, rng.end, rng.interval) if "nonNegativeDerivative" in names_of(tree) else rng
        out = self._eval(tree, wider, options)
        if not isinstance(out, Series):
            raise ValueError("a target must give series")
        return Series(out.df.where(F.col("epoch") >= rng.start), out.rng) if wider != rng else out

    def _eval(self, node, rng: TimeRange, options: dict):
        if isinstance(node, Path):
            return self.fetch(node.text, rng, options)
        if isinstance(node, Apply):
            if node.name not in registry.REGISTRY:
                raise ValueError(f"unknown function {node.name!r}")
            args = [self._eval(a, rng, options) for a in node.args]
            if node.name == "constantLine":
                return registry.REGISTRY[node.name](rng, *args, spark=self.points.sparkSession)
            return registry.REGISTRY[node.name](rng, *args)
        return node

    def fetch(self, path: str, rng: TimeRange, options: dict | None = None) -> Series:
        options = options or {}
        points = self.points.where(path_predicate(path, F.col("name")))
        dense = not self.sparse or options.get("sparseness_disabled") or any(re.fullmatch(glob(p), path) for p in self.fixed)
        if dense:
            return Series.of(resample_dense(points, rng, ["name"]), rng, F.col("name"))
        lookback = min(86400, int(options["lookback_sec"])) if "lookback_sec" in options else None
        return Series.of(resample(points, rng, ["name"], lookback=lookback), rng, F.col("name"))


def paths_of(node) -> list[str]:
    return [node.text] if isinstance(node, Path) else [p for a in node.args for p in paths_of(a)] if isinstance(node, Apply) else []


def names_of(node) -> set[str]:
    return {node.name} | {n for a in node.args for n in names_of(a)} if isinstance(node, Apply) else set()


def decomposable(target: str) -> bool:
    """Whether results of parts of a range make up the result of the whole."""
    return not (names_of(parse(target)[0]) & registry.NOT_DECOMPOSABLE)
