"""Configurations, prompts, ledger, code versions and checks of a project tree, on small trees made here."""

import hashlib
import json
import subprocess
from datetime import UTC, datetime

import pytest

from claimlens import governance as G
from claimlens import provenance as P
from claimlens.plans import competence, generation


def test_yaml_must_be_a_mapping(tmp_path):
    (tmp_path / "a.yaml").write_text("id: a\nx: [1, 2]\n")
    (tmp_path / "b.yaml").write_text("- 1\n")
    assert G.load_yaml(tmp_path / "a.yaml") == {"id": "a", "x": [1, 2]}
    with pytest.raises(G.ConfigError):
        G.load_yaml(tmp_path / "b.yaml")


def test_schema_breaches():
    schema = {
        "type": "object", "required": ["id", "n"], "additionalProperties": False, "$defs": {"name": {"type": "string", "pattern": "^[a-z]+$", "minLength": 2}},
        "properties": {"id": {"$ref": "#/$defs/name"}, "n": {"type": "integer", "minimum": 1, "exclusiveMaximum": 9}, "tags": {"type": "array", "items": {"enum": ["x", "y"]}, "uniqueItems": True, "maxItems": 2}, "v": {"anyOf": [{"type": "null"}, {"const": 3}]}, "w": {"oneOf": [{"type": "number"}, {"type": "integer"}]}},
    }
    assert G.schema_errors({"id": "ab", "n": 8, "tags": ["x", "y"], "v": None, "w": 0.5}, schema) == []
    for bad in ({"id": "ab"}, {"id": "A1", "n": 1}, {"id": "a", "n": 1}, {"id": "ab", "n": 0}, {"id": "ab", "n": 9}, {"id": "ab", "n": True}, {"id": "ab", "n": 1, "z": 0}, {"id": "ab", "n": 1, "tags": ["x", "x"]}, {"id": "ab", "n": 1, "tags": ["q"]}, {"id": "ab", "n": 1, "v": 4}, {"id": "ab", "n": 1, "w": 2}, []):
        assert len(G.schema_errors(bad, schema)) == 1, bad


@pytest.fixture()
def tree(tmp_path):
    def put(path, text):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)

    put("schema/detectors.json", json.dumps({"type": "object", "required": ["id"]}))
    put("detectors/forest.yaml", "id: forest\nversion: 2\nattribution_ref: attributions:tree\n")
    put("attributions/tree.yaml", "id: tree\n")
    put("datasets/one.yaml", "id: one\ncorrection: {applies: true, pipeline_version: '1'}\nchecksums: {raw: null, done: abc}\n")
    put("datasets/two.yaml", "id: two\n")
    put("experiments/e.yaml", "id: e\naxes:\n  datasets: [one, two]\n  detectors: [forest]\n")
    return tmp_path


def test_experiments_are_resolved(tree):
    configs = G.Configs(tree)
    made = configs.resolve_experiment("e")
    assert made["cells"] == [{"datasets": "one", "detectors": "forest"}, {"datasets": "two", "detectors": "forest"}]
    assert set(made["resolved"]) == {"datasets:one", "datasets:two", "detectors:forest", "attributions:tree"}
    assert configs.resolve("detectors:forest@2")["id"] == "forest"
    for bad in ("detectors:forest@1", "detectors:none", "nothing"):
        with pytest.raises(G.ConfigError):
            configs.resolve(bad)
    assert configs.validate_all() == []
    assert configs.integrity("1") == ([], 1) and len(configs.integrity("2")[0]) == 1


def test_faults_of_a_tree_are_found(tree):
    (tree / "detectors/lone.yaml").write_text("id: other\nattribution_ref: attributions:gone\n")
    (tree / "detectors/list.yaml").write_text("- 1\n")
    found = "\n".join(G.Configs(tree).validate_all())
    assert all(x in found for x in ("its id is other", "attributions:gone refers to nothing", "detectors/lone.yaml: nothing refers to it", "holds no mapping"))


def test_thresholds(tmp_path):
    assert G.thresholds() == {"macro_f1_min": 0.9, "recall_floor": 0.8, "min_support": 100, "class_failure_fraction": 0.5, "min_attack_classes": 3}
    (tmp_path / "t.yaml").write_text("recall_floor: 0.7\n")
    assert G.thresholds(tmp_path / "t.yaml")["recall_floor"] == 0.7
    (tmp_path / "t.yaml").write_text("strange: 1\n")
    with pytest.raises(G.ConfigError):
        G.thresholds(tmp_path / "t.yaml")


def test_prompts_agree_with_their_registry(tmp_path):
    (tmp_path / "p.txt").write_text("Explain.")
    good = hashlib.sha256(b"Explain.").hexdigest()
    (tmp_path / "REGISTRY.json").write_text(json.dumps({"prompts": {"p": {"1": {"path": "p.txt", "sha256": good}, "2": {"path": "p.txt", "sha256": "0"}}}}))
    prompts = G.Prompts(tmp_path)
    assert prompts.load("p", "1", good) == "Explain." and len(prompts.verify()) == 1
    for name, version, wanted in (("p", "2", None), ("p", "1", "0"), ("q", "1", None)):
        with pytest.raises(G.ConfigError):
            prompts.load(name, version, wanted)


def test_request_hash_is_that_of_canonical_json():
    one = G.request_hash("m", "s", "ä", {"b": 1, "a": None})
    assert one == hashlib.sha256('{"model_id":"m","params":{"a":null,"b":1},"prompt":"ä","snapshot_id":"s"}'.encode()).hexdigest()
    assert one != G.request_hash("m", "s", "ä", {"b": 1})


def test_ledger_appends_and_the_first_record_counts(spark, tmp_path):
    ledger = G.Ledger(spark, str(tmp_path / "ledger"))
    asked = spark.createDataFrame([("a",), ("b",)], "request_hash string")
    with pytest.raises(G.ReplayMiss):
        ledger.complete(asked)
    kind = "request_hash string, text string, tokens int, latency_ms double, number string"
    ledger.append(spark.createDataFrame([("a", "one", 1, None, "clash")], kind))
    ledger.append(spark.createDataFrame([("a", "two", 2, 3.0, "clash"), ("c", None, None, None, "clash")], kind))
    assert ledger.read().count() == 3
    assert {r["request_hash"]: r["text"] for r in ledger.first().collect()} == {"a": "one", "c": None}
    assert {(r["request_hash"], r["cached"]) for r in ledger.complete(asked, strict=False).collect()} == {("a", True), ("b", False)}
    with pytest.raises(Exception, match="must carry its hash"):
        ledger.append(spark.createDataFrame([(None, "x", 1, None, "clash")], kind))


def test_code_version_and_frozen_files(tmp_path):
    git = lambda *w: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *w], cwd=tmp_path, check=True, capture_output=True)
    git("init", "-q")
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(f"{name}\n")
    git("add", ".")
    git("commit", "-qm", "one")
    git("tag", "frozen")
    made = G.resolve_code_version(tmp_path)
    assert made.citable and len(made.commit) == 40
    (tmp_path / "a").write_bytes(b"a\r\n")
    (tmp_path / "b").write_text("other")
    (tmp_path / "c").unlink()
    assert [x.split()[0] + x.split()[1] for x in G.prereg_diff(tmp_path, "frozen", ["a", "b", "c", "d"])] == ["bdiffers", "cis", "dis"]
    with pytest.raises(RuntimeError):
        G.resolve_code_version(tmp_path)
    assert not G.resolve_code_version(tmp_path, allow_dirty=True).citable


def test_fingerprint_follows_its_fields(tmp_path, monkeypatch):
    one = G.fingerprint()
    assert one == G.fingerprint() and one["environment"]["lock"] is None
    monkeypatch.setenv("GPU_MODEL", "x")
    assert G.fingerprint()["environment_hash"] != one["environment_hash"]
    (tmp_path / "lock").write_text("1")
    assert G.fingerprint(tmp_path / "lock")["environment"]["lock"] == hashlib.sha256(b"1").hexdigest()


def test_links_lines_and_tables(spark, tmp_path):
    (tmp_path / "there.md").write_text("[a](https://x.y) [b](#z) ![c](gone.png) [d](there.md#p) [e](there.md:12) [f](gone.md)")
    assert G.broken_links(tmp_path) == [("there.md", "gone.md")]
    assert G.wrapped("aa bb  cccccc d", 5) == ["aa bb", "cccccc", "d"] and G.wrapped("") == []
    assert all(len(x) <= 20 for x in G.wrapped("one two three four five six seven eight nine ten", 20))
    G.latex_table(spark.createDataFrame([("b_1", 1 / 3), ("a", None)], "name string, v double"), ["name", "v"], ["name"], tmp_path / "t.tex")
    assert json.loads((tmp_path / "t.data.json").read_text()) == [{"name": "a", "v": None}, {"name": "b_1", "v": 0.333333}]
    assert r"b\_1 & 0.333333 \\" in (tmp_path / "t.tex").read_text()


def test_run_ids_and_files_of_one_name(spark, tmp_path):
    run = P.mint_run_id("EXP-1", "abcdef0123", datetime(2026, 8, 12, 9, 30, tzinfo=UTC))
    assert run == "EXP-1__abcdef0__2026-08-12T0930Z"
    assert P.parse_run_id(run) == {"experiment": "EXP-1", "commit": "abcdef0", "utc": "2026-08-12T0930Z"}
    for bad in ("EXP__abcdef0__20260812T093000Z", "EXP__abcdef__2026-08-12T0930Z"):
        with pytest.raises(ValueError):
            P.parse_run_id(bad)
    for name, text in (("a/x", "1"), ("b/x", "2"), ("c/y", "1")):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    made = {r["name"]: r["sha256"] for r in P.file_hashes(spark, str(tmp_path)).collect()}
    assert made == {n: hashlib.sha256(t).hexdigest() for n, t in (("a/x", b"1"), ("b/x", b"2"), ("c/y", b"1"))}
    assert P.verify_outputs(spark, str(tmp_path), made | {"b/x": made["a/x"], "d": "0"}).count() == 2
    assert {r["name"] for r in P.without_copies(spark, str(tmp_path)).collect()} == {"a/x", "b/x"}


def test_a_weak_detector_is_no_reason_to_merge():
    table = {c: {"n": 500, "recall": 0.95} for c in ("a", "b", "c")}
    vocabulary = ("BENIGN", "a", "b", "c")
    assert competence.resolve(table, vocabulary, {}, macro_f1=0.5).detector_defect
    sound = competence.resolve(table, vocabulary, {}, macro_f1=0.95)
    assert not sound.detector_defect and sound.vocabulary == vocabulary


def test_every_test_name_is_dispatched():
    assert {"friedman_nemenyi", "mean_ci", "coverage_risk", "cost_summary", "layer2_per_class", "layer2_redundancy", "capability_scaling"} <= set(generation.TESTS)
    with pytest.raises(KeyError):
        generation.build_result(None, "", "none")
