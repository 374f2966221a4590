"""Configurations, prompts, the call ledger, code versions and checks of a project tree.

All of it is small and stays on the driver, but for the ledger, which is a table.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import platform
import re
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.provenance import canonical_json


class ConfigError(ValueError):
    """A configuration that cannot be read, breaks its schema or refers to nothing."""


# Configurations


def load_yaml(path: str | Path) -> dict:
    """IO-08: a YAML file whose top level is a mapping."""
    import yaml

    made = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(made, dict):
        raise ConfigError(f"{path} holds no mapping at its top level")
    return made


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is_kind(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        whole = isinstance(value, int) or (isinstance(value, float) and value.is_integer())
        return not isinstance(value, bool) and (whole if kind == "integer" else isinstance(value, (int, float)))
    return isinstance(value, _KINDS[kind])


def schema_errors(value: object, schema: dict, at: str = "$", root: dict | None = None) -> list[str]:
    """PF-17: breaches of a JSON schema (type, enum, const, bounds, pattern, items, properties, combinations, local references)."""
    root = schema if root is None else root
    if "$ref" in schema:
        target: dict = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        return schema_errors(value, target, at, root)
    found = []
    kinds = schema.get("type")
    if kinds is not None and not any(_is_kind(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at} is no {kinds}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at} is none of {schema['enum']}")
    if "const" in schema and value != schema["const"]:
        found.append(f"{at} is not {schema['const']!r}")
    if isinstance(value, str):
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at} does not match {schema['pattern']}")
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            found.append(f"{at} has {len(value)} characters")
    if _is_kind(value, "number"):
        for key, breached in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value)), ("exclusiveMinimum", "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]), ("exclusiveMaximum", "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"])):
            if breached:
                found.append(f"{at} breaks {key} {schema[key]}")
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            found.append(f"{at} has {len(value)} items")
        if schema.get("uniqueItems") and len({canonical_json(x) for x in value}) < len(value):
            found.append(f"{at} repeats an item")
        for i, x in enumerate(value):
            found += schema_errors(x, schema.get("items", {}), f"{at}[{i}]", root)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at} lacks {k}" for k in schema.get("required", ()) if k not in value]
        rest = schema.get("additionalProperties", True)
        for k, x in value.items():
            if k in known:
                found += schema_errors(x, known[k], f"{at}.{k}", root)
            elif rest is False:
                found.append(f"{at} has an unknown {k}")
            elif isinstance(rest, dict):
                found += schema_errors(x, rest, f"{at}.{k}", root)
    for part in schema.get("allOf", ()):
        found += schema_errors(value, part, at, root)
    for key, least, most in (("anyOf", 1, None), ("oneOf", 1, 1)):
        if key in schema:
            fits = sum(not schema_errors(value, part, at, root) for part in schema[key])
            if fits < least or (most is not None and fits > most):
                found.append(f"{at} fits {fits} of {key}")
    return found


#: CP-09, fixed values: what a detector's competence must reach.
THRESHOLDS = {"macro_f1_min": 0.9, "recall_floor": 0.8, "min_support": 100, "class_failure_fraction": 0.5, "min_attack_classes": 3}


def thresholds(path: str | Path | None = None) -> dict[str, float]:
    """CP-09: the defaults, with what a file states in their place; unknown names are an error."""
    stated = load_yaml(path) if path is not None else {}
    strange = stated.keys() - THRESHOLDS.keys()
    if strange:
        raise ConfigError(f"no thresholds: {', '.join(sorted(strange))}")
    return THRESHOLDS | stated


class Configs:
    """Configurations below a folder: ``<family>/<id>.yaml``, each with its ``id``; schemas are ``schema/<family>.json``."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def files(self) -> list[Path]:
        return sorted(p for p in self.root.glob("*/*.yaml") if p.parent.name != "schema")

    def resolve(self, reference: str) -> dict:
        """PV-12: ``family:id`` or ``family:id@version``; a version must be the one in the file."""
        met = re.fullmatch(r"([a-z_]+):([\w.-]+?)(?:@([\w.-]+))?", reference)
        if not met:
            raise ConfigError(f"{reference} is no reference")
        family, name, version = met.groups()
        path = self.root / family / f"{name}.yaml"
        if not path.is_file():
            raise ConfigError(f"{reference} refers to nothing")
        made = load_yaml(path)
        if version is not None and str(made.get("version")) != version:
            raise ConfigError(f"{reference} is at version {made.get('version')} now")
        return made

    def references(self, value: object) -> list[str]:
        """References inside a configuration: values of keys that end in ``_ref`` or ``_refs``."""
        if isinstance(value, list):
            return [r for x in value for r in self.references(x)]
        if not isinstance(value, dict):
            return []
        own = [r for k, x in value.items() if k.endswith(("_ref", "_refs")) for r in (x if isinstance(x, list) else [x]) if isinstance(r, str)]
        return own + [r for x in value.values() if isinstance(x, (dict, list)) for r in self.references(x)]

    def resolve_experiment(self, name: str) -> dict:
        """PV-12: the experiment, everything it refers to, however far, and its cells (all combinations of its axes)."""
        experiment = self.resolve(f"experiments:{name}")
        resolved: dict[str, dict] = {}
        axes = experiment.get("axes", {})
        open_ = self.references(experiment) + [f"{family}:{i}" for family, ids in axes.items() for i in ids]
        while open_:
            reference = open_.pop()
            if reference not in resolved:
                resolved[reference] = self.resolve(reference)
                open_ += self.references(resolved[reference])
        cells = [dict(zip(axes, chosen, strict=True)) for chosen in itertools.product(*axes.values())] if axes else []
        return {"experiment": experiment, "resolved": resolved, "cells": cells}

    def validate_all(self) -> list[str]:
        """PV-13: schema breaches, ids that are not the file's name, references to nothing, and files nothing refers to."""
        found, used = [], set()
        for path in self.files():
            at = path.relative_to(self.root).as_posix()
            try:
                made = load_yaml(path)
            except ConfigError as error:
                found.append(str(error))
                continue
            schema = self.root / "schema" / f"{path.parent.name}.json"
            if schema.is_file():
                found += [f"{at}: {e}" for e in schema_errors(made, json.loads(schema.read_text()))]
            if made.get("id") != path.stem:
                found.append(f"{at}: its id is {made.get('id')}")
            wanted = self.references(made) + [f"{f}:{i}" for f, ids in made.get("axes", {}).items() for i in ids]
            for reference in wanted:
                try:
                    self.resolve(reference)
                    used.add(reference.split("@")[0])
                except ConfigError as error:
                    found.append(f"{at}: {error}")
        orphans = [p for p in self.files() if p.parent.name != "experiments" and f"{p.parent.name}:{p.stem}" not in used]
        return found + [f"{p.relative_to(self.root).as_posix()}: nothing refers to it" for p in orphans]

    def integrity(self, version: str) -> tuple[list[str], int]:
        """PV-18: datasets whose stated correction is not the one that is built, and how many checksums are still open."""
        found, pending = [], 0
        for path in (p for p in self.files() if p.parent.name == "datasets"):
            made = load_yaml(path)
            correction = made.get("correction", {})
            if correction.get("applies") and correction.get("pipeline_version") != version:
                found.append(f"{path.stem}: stated {correction.get('pipeline_version')}, built {version}")
            pending += sum(x is None for x in made.get("checksums", {}).values())
        return found, pending


# Prompts and calls


class Prompts:
    """LL-06: prompts by name and version; file, registry and caller must agree on the hash."""

    def __init__(self, root: str | Path):
        self.root = Path(root)
        self.registry = json.loads((self.root / "REGISTRY.json").read_text(encoding="utf-8"))["prompts"]

    def load(self, name: str, version: str, wanted: str | None = None) -> str:
        entry = self.registry.get(name, {}).get(version)
        if entry is None:
            raise ConfigError(f"no prompt {name} at {version}")
        data = (self.root / entry["path"]).read_bytes()
        for said, where in ((entry["sha256"], "the registry"), (wanted, "the caller")):
            if said is not None and hashlib.sha256(data).hexdigest() != said:
                raise ConfigError(f"the file of {name} at {version} is not the one that {where} means")
        return data.decode("utf-8")

    def verify(self) -> list[str]:
        found = []
        for name, versions in self.registry.items():
            for version in versions:
                try:
                    self.load(name, version)
                except (ConfigError, OSError) as error:
                    found.append(str(error))
        return found


def request_hash(model_id: str, snapshot_id: str, prompt: str, params: dict) -> str:
    """LL-01: sha256 of the canonical JSON of what determines an answer."""
    return hashlib.sha256(canonical_json({"model_id": model_id, "snapshot_id": snapshot_id, "prompt": prompt, "params": params}).encode()).hexdigest()


class ReplayMiss(LookupError):
    """A strict replay asked for a call that was never made."""


class Ledger:
    """IO-12, LL-02, LL-03: calls appended to a table and looked up by hash; the first record of a hash counts.

    Records get a number when they are appended, so that the first is the first appended.
    """

    SCHEMA = "request_hash string, number long, text string, tokens int, latency_ms double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def append(self, calls: DataFrame) -> None:
        """``calls`` has (request_hash, text, tokens, latency_ms); a null hash is an error."""
        last = self.read().agg(F.max("number")).first()[0]
        key = F.when(F.col("request_hash").isNull(), F.raise_error(F.lit("a record must carry its hash"))).otherwise(F.col("request_hash"))
        numbered = calls.select(key.alias("request_hash"), (F.monotonically_increasing_id() + F.lit(0 if last is None else last + 1)).alias("number"), "text", "tokens", "latency_ms")
        numbered.write.mode("append").parquet(self.path)

    def first(self) -> DataFrame:
        kept = self.read().groupBy("request_hash").agg(F.min_by(F.struct("text", "tokens", "latency_ms"), "number").alias("x"))
        return kept.select("request_hash", "x.*")

    def complete(self, asked: DataFrame, strict: bool = True) -> DataFrame:
        """``asked`` (request_hash) with the stored answers; a strict replay raises where there is none."""
        met = asked.join(self.first().withColumn("cached", F.lit(True)), "request_hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
        if strict and (missing := met.filter("NOT cached").limit(10).collect()):
            raise ReplayMiss(", ".join(str(r["request_hash"]) for r in missing))
        return met


# Code and environment


@dataclass(frozen=True)
class CodeVersion:
    commit: str
    dirty: bool

    @property
    def citable(self) -> bool:
        return not self.dirty


def _git(repo: str | Path, *words: str) -> str:
    return subprocess.run(["git", *words], cwd=repo, check=True, capture_output=True, text=True).stdout.strip()


def resolve_code_version(repo: str | Path = ".", allow_dirty: bool = False) -> CodeVersion:
    """PV-06: the commit; changes that are not committed are refused, or make the version one not to be cited."""
    made = CodeVersion(_git(repo, "rev-parse", "HEAD"), _git(repo, "status", "--porcelain") != "")
    if made.dirty and not allow_dirty:
        raise RuntimeError("there are changes that are not committed")
    return made


def prereg_diff(repo: str | Path, tag: str, files: list[str]) -> list[str]:
    """PV-16: frozen files that are absent at the tag or differ from it now, line ends and outer blanks left out."""
    plain = lambda text: text.replace("\r\n", "\n").strip()
    found = []
    for name in files:
        try:
            then = _git(repo, "show", f"{tag}:{name}")
        except subprocess.CalledProcessError:
            found.append(f"{name} is absent at {tag}")
            continue
        path = Path(repo) / name
        if not path.is_file():
            found.append(f"{name} is gone")
        elif plain(path.read_text(encoding="utf-8")) != plain(then):
            found.append(f"{name} differs from {tag}")
    return found


def fingerprint(lock_file: str | Path | None = None, variables: tuple[str, ...] = ("CONTAINER_IMAGE_DIGEST", "GPU_MODEL", "GPU_DRIVER_VERSION", "CUDNN_VERSION", "CUDA_VERSION")) -> dict:
    """PV-20: what the results may depend on, with the hash of its canonical JSON; what is not recorded is null."""
    lock = Path(lock_file) if lock_file is not None else None
    fields = {
        "lock": hashlib.sha256(lock.read_bytes()).hexdigest() if lock is not None and lock.is_file() else None,
        "system": {"name": platform.system(), "release": platform.release(), "machine": platform.machine()},
        "python": {"implementation": platform.python_implementation(), "version": platform.python_version()},
        "variables": {v: os.environ.get(v) for v in variables},
    }
    return {"environment": fields, "environment_hash": hashlib.sha256(canonical_json(fields).encode()).hexdigest()}


# Texts


def broken_links(root: str | Path) -> list[tuple[str, str]]:
    """TX-14: (file, target) of links in Markdown files below a folder that lead to no file; addresses and anchors are left out."""
    found = []
    for path in sorted(Path(root).rglob("*.md")):
        if any(part.startswith(".") for part in path.relative_to(root).parts):
            continue
        for target in re.findall(r"(?<!!)\[[^\]\n]*\]\(([^)\s]+)[^)]*\)", path.read_text(encoding="utf-8")):
            if re.match(r"[a-z][a-z0-9+.-]*:|#", target):
                continue
            file = re.sub(r":\d+$", "", target.split("#")[0])
            if file and not (path.parent / file).exists():
                found.append((path.relative_to(root).as_posix(), target))
    return found


def wrapped(text: str, width: int = 74) -> list[str]:
    """TX-15: words filled into lines of at most ``width``; a longer word stands alone."""
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += " " + word
        else:
            lines.append(word)
    return lines


def latex_table(df: DataFrame, columns: list[str], order: list[str], path: str | Path, digits: int = 6) -> None:
    """IO-18: a small result as a LaTeX table, and its numbers beside it as ``.data.json``, rounded; the result is an aggregate."""
    rows = [r.asDict() for r in df.select(*columns).orderBy(*order).collect()]
    plain = [{k: round(v, digits) if isinstance(v, float) else v for k, v in r.items()} for r in rows]
    escape = lambda v: re.sub(r"([_&%#$])", r"\\\1", str(v))
    body = [" & ".join(escape(r[c]) for c in columns) + r" \\" for r in plain]
    head = [rf"\begin{{tabular}}{{{'l' * len(columns)}}}", " & ".join(escape(c) for c in columns) + r" \\", r"\hline"]
    Path(path).write_text("\n".join([*head, *body, r"\end{tabular}"]) + "\n", encoding="utf-8")
    Path(path).with_suffix(".data.json").write_text(json.dumps(plain, sort_keys=True, indent=1, ensure_ascii=False) + "\n", encoding="utf-8")
