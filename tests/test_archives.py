"""Repositories as tar archives: few rows for many files, and every file back as it was."""

from __future__ import annotations

import io
import tarfile

from corpusmill.plans import corpus_queries
from corpusmill.sources import corpus


def test_documents_become_few_files(spark, tmp_path, monkeypatch):
    rows = [(k, f"text {k} ä", ("en", "de", "x" * 200, None)[k % 4], f"src{k % 3}" if k % 5 else None) for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_queries, "work_dir", lambda spark, name: str(tmp_path / "shared"))
    got = {(r.repo_id, r.path, r.bytes) for r in corpus_queries.QUERIES["s16_scan_files"](spark, str(tmp_path)).collect()}
    size = lambda k, text: len(text.encode()) + 1 + (k % 50 == 0)
    assert got == {(source, lang and f"{lang}/{k}.md", size(k, text)) for k, text, lang, source in rows if k % 50 != 7}
    assert len([p for p in (tmp_path / "shared").rglob("*.parquet")]) <= 4 and len(list((tmp_path / "shared").rglob("*"))) < 50


def test_archives_end_by_size(spark, monkeypatch):
    rows = [(f"r{k % 7}", f"a/ü{k}.txt", bytes([k % 256]) * (k % 5000)) for k in range(700)] + [("r0", "empty", b"")]
    files = spark.createDataFrame(rows, "repo_id string, path string, content binary").coalesce(1)
    monkeypatch.setattr(corpus, "ARCHIVE_BYTES", 50_000)
    monkeypatch.setattr(corpus, "HELD_BYTES", 120_000)
    archives = corpus.packed(files).collect()
    assert 14 < len(archives) < 80
    back = corpus.scan_archives(spark.createDataFrame(archives, "repo_id string, archive binary")).collect()
    assert sorted((r.repo_id, r.path, bytes(r.content)) for r in back) == sorted(rows) and all(r.bytes == len(r.content) for r in back)


def test_archives_as_a_host_sends_them(spark):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz", format=tarfile.PAX_FORMAT, pax_headers={"comment": "1a2b"}) as tar:
        for name, kind, body in (("acme-1a2b", tarfile.DIRTYPE, b""), ("acme-1a2b/src/a.ts", tarfile.REGTYPE, b"let a = 1;"), ("acme-1a2b/link", tarfile.SYMTYPE, b"")):
            member = tarfile.TarInfo(name)
            member.type, member.size = kind, len(body)
            tar.addfile(member, io.BytesIO(body))
    got = corpus.scan_archives(spark.createDataFrame([("acme", data.getvalue()), ("none", None)], "repo_id string, archive binary")).collect()
    assert [(r.repo_id, r.path, bytes(r.content), r.bytes) for r in got] == [("acme", "src/a.ts", b"let a = 1;", 10)]
