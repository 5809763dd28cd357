"""The audit over real files."""

import hashlib

import pytest

from recipeflow.operators import audit
from recipeflow.operators.audit import audit_files, audit_manifest, audit_summary


@pytest.mark.parametrize("most", [0, 10_000])
def test_files_of_a_folder(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(audit, "MOST_NAMES", most)
    files = {"a.bin": b"a" * 2000, "sub/a.bin": b"b" * 2000, "sub/x y%20é.bin": b"c" * 1025, "small": b"d" * 1024, "empty": b"", "unlisted": b"e" * 5000}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    digest = {name: hashlib.sha256(data).hexdigest() for name, data in files.items()}
    rows = [
        ("right", "a.bin", digest["a.bin"].upper()), ("wrong", "sub/a.bin", digest["a.bin"]), ("odd name", "sub/x y%20é.bin", digest["sub/x y%20é.bin"]),
        ("odd, no hash", "sub/x y%20é.bin", ""), ("no hash", "a.bin", None), ("small", "small", digest["small"]), ("empty", "empty", None),
        ("none", "gone", digest["a.bin"]), ("none, no hash", "gone2", None), ("no path", None, digest["a.bin"]), ("right", "a.bin", digest["a.bin"]),
    ]
    manifest = spark.createDataFrame(rows, "key string, path string, sha256 string")
    out = audit_files(manifest, str(tmp_path))
    got = sorted((r["key"], r["path"] or "", r["size"], r["status"]) for r in out.collect())
    objects = spark.createDataFrame([(n, len(d), bytearray(d)) for n, d in files.items() if d], "path string, size long, content binary")
    assert got == sorted((r["key"], r["path"] or "", r["size"], r["status"]) for r in audit_manifest(manifest, objects).collect())
    assert {k: s for k, _, _, s in got} == {
        "right": "ok", "wrong": "hash_mismatch", "odd name": "ok", "odd, no hash": "ok", "no hash": "ok", "small": "too_small", "empty": "missing",
        "none": "missing", "none, no hash": "missing", "no path": "missing",
    }
    assert audit_summary(out).first()["n_ok"] == 5
    plan = audit_files(manifest, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    plain = audit_files(manifest.where("path in ('a.bin', 'sub/a.bin')"), str(tmp_path))  # only listed names
    assert {(r["key"], r["status"]) for r in plain.collect()} == {("right", "ok"), ("wrong", "hash_mismatch"), ("no hash", "ok")}
    reads = [p.split(">")[0] for p in plan.split("ReadSchema: struct<")[1:]]
    assert sorted("content" in r for r in reads) == [False, False, True]
    assert "GreaterThan(length,1024)" in plan
    assert audit_files(manifest.where("false"), str(tmp_path)).count() == 0
