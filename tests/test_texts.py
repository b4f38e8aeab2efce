from __future__ import annotations

import hashlib
import json
import os
import pickle

import pytest
from pyspark.sql import functions as F

from orrery.functions import structured
from orrery.functions import text as X
from orrery.operators import chunking as K
from orrery.sources import files, snapshots, tables
from orrery.streaming import ingest, progress, rate_limit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, X.normalize_tag(F.lit("  Foo   BAR "))) == "foo bar" and one(spark, X.normalize_tag(F.lit(" \t "))) is None
    assert one(spark, X.chunk_id(F.lit("doc1"), F.lit(0))) == hashlib.sha256(b"doc1:0").hexdigest()
    assert [one(spark, X.progress_percent(F.lit(a), F.lit(b))) for a, b in ((1, 8), (3, 8), (1, 0))] == [12, 38, None]
    assert [one(spark, X.clamped(F.lit(v))) for v in ("0.5", "7", "-1", "high", None)] == [0.5, 1.0, 0.0, 0.0, 0.0]
    assert one(spark, X.confidence_of_rank(F.lit(20))) == 0.3
    assert one(spark, X.language_of(F.lit("/a/B.TSX"))) == "tsx" and one(spark, X.language_of(F.lit("/a/b"))) is None
    assert [one(spark, X.symbol_kind(F.lit(t))) for t in ("method_declaration", "class_definition", "function_item")] == ["method", "class", "function"]
    assert one(spark, X.topic_parts(F.lit("ingest:c1:x"))) == ("ingest", "c1:x")
    assert one(spark, X.highlighted(F.lit("A Cat, cats (x)"), "cat a (x")) == "A <mark>Cat</mark>, <mark>cat</mark>s <mark>(x</mark>)"
    assert one(spark, X.unmasked(X.masked(F.lit("s3cret")), F.lit("s3cret"))) == "s3cret"
    assert one(spark, X.heat_share(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, X.breadcrumb(F.array(F.lit("Title"), F.lit("Section A")))) == "Title > Section A"


def test_json(spark):
    text = json.dumps({"user": {"name": "X", "roles": ["a", "b"]}, "none": None, "e": {}, "f": []})
    rows = spark.createDataFrame([(text,), ("[",), (None,)], "t string")
    got = rows.select(structured.flatten_json("t").alias("x"), structured.json_depth("t").alias("d")).collect()
    assert [tuple(p) for p in got[0].x] == [("user.name", "X"), ("user.roles[0]", "a"), ("user.roles[1]", "b"), ("none", "None")]
    assert got[0].d == 4 and got[1].x is None and got[2].d is None


def windows(words, size, overlap):
    out, at = [], 0
    while True:
        out.append(words[at : at + size])
        if at + size >= len(words):
            return out
        at += size - overlap


def test_windows_and_groups(spark):
    words = [f"w{i}" for i in range(1000)]
    texts = spark.createDataFrame([(n, " ".join(words[:n])) for n in (0, 1, 7, 8, 9, 13, 14, 1000)] + [(-1, None)], "n int, text string")
    got = {}
    for r in K.sliding_windows(texts, size=8, overlap=3).orderBy("n", "chunk_index").collect():
        got.setdefault(r.n, []).append(r.chunk)
    for n in (1, 7, 8, 9, 13, 14, 1000):
        assert got[n] == [" ".join(w) for w in windows(words[:n], 8, 3)], n
    assert 0 not in got and -1 not in got
    with pytest.raises(ValueError):
        K.sliding_windows(texts, size=8, overlap=8)
    rows = spark.createDataFrame([("k", i, f"r{i}") for i in range(25)], "k string, i int, text string")
    groups = K.row_groups(rows, "k", "i").orderBy("chunk_index").collect()
    assert [r.row_range for r in groups] == ["0-9", "10-19", "20-24"] and groups[2].text == "r20\nr21\nr22\nr23\nr24" and groups[0].total_rows == 25
    with pytest.raises(ValueError):
        K.row_groups(rows, "k", "i", size=0)
    lines = spark.createDataFrame([("a\nb\r\n\n\n\n\n  c  ",)], "text string")
    assert [r.chunk for r in K.line_windows(lines, lines=2).orderBy("chunk_index").collect()] == ["a\nb", "c"]


def packed(paragraphs, size, overlap):
    out, held, n = [], [], 0
    for p in paragraphs:
        words = p.split()
        if len(words) > size:
            out += ["\n\n".join(held)] * bool(held) + [" ".join(w) for w in windows(words, size, overlap)]
            held, n = [], 0
        elif n + len(words) > size:
            out.append("\n\n".join(held))
            held, n = [p], len(words)
        else:
            held.append(p)
            n += len(words)
    return out + ["\n\n".join(held)] * bool(held)


def test_paragraphs_are_packed(spark):
    cases = [["a b", "c d e", "f"], ["a b c d e f g h i j k l"], ["a", "b c d e f g h i", "j"], ["a b c d", "e f"]]
    texts = spark.createDataFrame([(i, "\n\n".join(c)) for i, c in enumerate(cases)] + [(9, " \n\n ")], "i int, text string")
    got = {}
    for r in K.packed_paragraphs(texts, size=5, overlap=2).orderBy("i", "chunk_index").collect():
        got.setdefault(r.i, []).append(r.chunk)
    assert got == {i: packed(c, 5, 2) for i, c in enumerate(cases)}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "a.txt").write_text("first para\n\nsecond para")
    (root / "b.md").write_text("intro\n\n# Title\n\ntext\n\n## Section A\nbody\n```\n# no heading\n```\n\nOther\n=====\nlast")
    (root / "c.csv").write_text('name,age\nAlice,30\n"Bob, jr",\n')
    (root / "d.json").write_text('[{"a":1,"b":2},{"a":3,"b":4}]')
    (root / "e.json").write_text('{"user":{"name":"X"}}')
    (root / "f.py").write_text("def greet():\n    pass\n\nclass Greeter:\n    def hello(self):\n        return 1\n")
    (root / "g.go").write_text("\n".join(f"line {i}" for i in range(60)))
    (root / "h.py").write_text("x = 1\n")
    return root


def test_files_become_chunks(spark, folder):
    found = files.with_document_id(files.files(spark, str(folder)))
    by = {}
    for r in files.parse_files(found).orderBy("filename", "chunk_index").collect():
        by.setdefault(r.filename, []).append(r)
    assert [r.text for r in by["a.txt"]] == ["first para\n\nsecond para"]
    assert [(r.heading_path, r.heading_level) for r in by["b.md"]] == [(None, None), ("Title", 1), ("Title > Section A", 2), ("Other", 1)]
    assert [r.text for r in by["c.csv"]] == ["name=Alice; age=30\nname=Bob, jr; age="] and by["c.csv"][0].columns == ["name", "age"] and by["c.csv"][0].row_range == "0-1"
    assert by["d.json"][0].text == "a=1; b=2\na=3; b=4" and by["d.json"][0].json_shape == "array"
    assert by["e.json"][0].text == "user.name=X" and (by["e.json"][0].depth, by["e.json"][0].key_count) == (3, 1)
    assert [(r.symbol_name, r.symbol_type, r.start_line, r.end_line) for r in by["f.py"]] == [("greet", "function", 1, 2), ("Greeter", "class", 4, 6), ("hello", "function", 5, 6)]
    assert len(by["g.go"]) == 2 and {r.language for r in by["g.go"]} == {"go"} and by["h.py"][0].text == "x = 1"
    assert all(r.chunk_id == hashlib.sha256(f"{r.document_id}:{r.chunk_index}".encode()).hexdigest() for rows in by.values() for r in rows)
    assert files.rejected_files(found).count() == 0
    rows = files.csv_rows(spark, str(folder / "c.csv")).collect()
    assert [r.text for r in rows] == ["name=Alice; age=30", "name=Bob, jr; age="]


def test_a_dirty_folder_stops_nothing(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("caf\u00e9 au lait".encode("latin-1"))
    (tmp_path / "b.json").write_text("[{")
    (tmp_path / "c.json").write_text(json.dumps([{"i": i} for i in range(30_000)]))
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 page one\fpage two")
    (tmp_path / "i.txt").write_bytes(b" \n")
    (tmp_path / "e.docx").write_bytes(b"PK")
    (tmp_path / "f.zip").write_bytes(b"PK")
    (tmp_path / "noext").write_bytes(b"x")
    (tmp_path / "g.txt").write_bytes(b"x" * 3_000_000)
    (tmp_path / "h.go").write_bytes(b"// \xff\nok")
    found = files.with_document_id(files.files(spark, str(tmp_path), max_bytes=2_000_000))
    rejects = {r.filename: r.reason for r in files.rejected_files(found).collect()}
    assert set(rejects) == {"b.json", "d.pdf", "e.docx", "f.zip", "noext", "g.txt", "i.txt"}
    assert rejects["f.zip"] == "no parser for .zip" and rejects["noext"] == "no parser for a name without extension" and rejects["g.txt"] == "too large" and rejects["d.pdf"] == rejects["i.txt"] == "no text" and rejects["b.json"].startswith("malformed")
    chunks = files.parse_files(found).select("filename", "chunk_index", "text").collect()
    assert {r.filename for r in chunks} == {"a.txt", "c.json", "h.go"}
    assert [r.text for r in chunks if r.filename == "a.txt"] == ["caf\u00e9 au lait"]
    rows = sorted((r.chunk_index, r.text) for r in chunks if r.filename == "c.json")
    assert len(rows) == 3000 and rows[2999] == (2999, "\n".join(f"i={i}" for i in range(29_990, 30_000)))

    def pages(data):
        if not data.startswith(b"%PDF"):
            raise ValueError("no PDF")
        texts = data.decode().split("\f")
        return [{"text": t, "page_number": i + 1, "total_pages": len(texts)} for i, t in enumerate(texts)]

    parsers = {"pdf": pages, "docling": pages}
    got = files.parse_files(found, parsers=parsers).where("parser = 'pdf'").orderBy("chunk_index").collect()
    assert [(r.text, r.page_number, r.total_pages) for r in got] == [("%PDF-1.4 page one", 1, 2), ("page two", 2, 2)]
    assert {r.filename: r.reason for r in files.rejected_files(found, parsers=parsers).collect()}["e.docx"] == "malformed: ValueError: no PDF"


def test_ingest_reports_and_retries(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("one text")
    (inbox / "b.json").write_text("{")
    root, check = str(tmp_path / "tables"), str(tmp_path / "check")
    tries = []

    def embed(chunks):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("the model isn't there yet")
        return chunks

    stream = ingest.ingest_stream(spark, str(inbox), root, check, embed, backoff=0.01)
    stream.trigger(availableNow=True).start().awaitTermination()
    assert len(tries) == 3 and tables.read(spark, root, "chunks").count() == 1
    assert [r.filename for r in tables.read(spark, root, "rejected").collect()] == ["b.json"]
    assert sorted(r.phase for r in tables.read(spark, root, "progress").collect()) == ["done", "embedding", "parsing", "storing"]
    assert not [p for p in (tmp_path / "tables").iterdir() if p.name.startswith("staged")]
    with pytest.raises(OSError):
        ingest.retried(lambda: embed(tries.clear()), retries=1, backoff=0.01)


def test_a_batch_writes_its_own_files_and_counts_once(spark, folder, tmp_path):
    root = str(tmp_path / "t")
    ingest.ingest(spark, files.files(spark, str(folder)), root, batch="first")
    before = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    n = tables.read(spark, root, "chunks").count()
    (folder / "b.md").write_text("# Only\n\none")
    (folder / "d.json").write_text("{")  # malformed now: its chunks go
    some = files.files(spark, str(folder)).where("filename IN ('b.md', 'd.json')")
    version = ingest.ingest(spark, some, root, batch="second")
    assert ingest.ingest(spark, some, root, batch="second") == version == tables.state(spark, root)["version"]
    new = [p for p in (tmp_path / "t" / "data").iterdir() if p.name not in before and p.name.startswith("chunks-") and "gone" not in p.name]
    assert len(new) == 1 and spark.read.parquet(str(new[0])).count() == 1
    after = tables.read(spark, root, "chunks")
    assert after.count() == n - 4 - 1 + 1
    assert [r.text for r in after.where("filename = 'b.md'").collect()] == ["Only\n\none"]
    assert {(r.filename, r.chunk_count, r.job_status) for r in tables.read(spark, root, "documents").where("filename IN ('b.md', 'd.json')").collect()} == {("b.md", 1, "done"), ("d.json", 0, "failed")}
    assert tables.read(spark, root, "progress").where("batch = 'second'").count() == 4
    plan = files.parsed(files.with_document_id(files.files(spark, str(folder))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("content#") and plan.count("BinaryFileFormat") + plan.count("binaryFile") <= 4


def test_tags_are_folded_and_suggested(spark, tmp_path):
    (tmp_path / "a.txt").write_text("about whales")
    found = files.files(spark, str(tmp_path))
    doc = files.with_document_id(found).first().document_id
    effective = spark.createDataFrame([(doc, ["sea", "animal"])], "document_id string, tags array<string>")
    reply = F.when(F.col("prompt").contains("whales"), '[{"name": "Whales ", "confidence": 0.9}, {"name": "sea", "confidence": "1"}, {"name": "fish", "confidence": 0.1}]')
    ingest.ingest(spark, found, str(tmp_path / "t"), effective=effective, suggest=lambda rows: rows.select("id", reply.alias("reply")))
    assert [r.tags for r in tables.read(spark, str(tmp_path / "t"), "chunks").collect()] == [["animal", "sea", "whales"]]


def test_snapshots_and_corpus(spark, tmp_path):
    root = str(tmp_path / "table")
    assert snapshots.versions(spark, root) == []
    assert snapshots.commit(spark.range(3), root) == 1 and snapshots.commit(spark.range(5), root) == 2
    assert snapshots.current(spark, root).count() == 5
    os.makedirs(f"{root}/v3")  # a driver was killed while writing it
    assert snapshots.commit(spark.range(7), root) == 4 and snapshots.current(spark, root).count() == 7
    rows = spark.createDataFrame([("c", '[["k1","d1","text"],["short"],["k2","d2",""]]'), ("bad", "{")], "collection_id string, entries string")
    assert [(r.chunk_id, r.document_id) for r in snapshots.corpus_of_json(rows).collect()] == [("k1", "d1"), ("k2", "d2")]


def test_ingest_stream_is_idempotent(spark, folder, tmp_path):
    root, check = str(tmp_path / "chunks"), str(tmp_path / "check")
    for _ in range(2):
        ingest.ingest_stream(spark, str(folder), root, check).trigger(availableNow=True).start().awaitTermination()
    assert tables.numbers(spark, root) == [1]
    n = tables.read(spark, root, "chunks").count()
    ingest.ingest(spark, files.files(spark, str(folder)), root)
    assert tables.read(spark, root, "chunks").count() == n


def test_commits_merge_restore_and_survive_a_killed_one(spark, tmp_path):
    root = str(tmp_path / "t")

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "k string, v int")

    def now(name="a", version=None):
        return sorted(map(tuple, tables.read(spark, root, name, version).collect()))

    one = tables.commit(spark, root, {"a": tables.Change(rows(("x", 1), ("y", 1), ("y", 2))), "b": tables.Change(rows(("q", 1)))})
    two = tables.commit(spark, root, {"a": tables.Change(rows(("y", 3)), rows(("y", 0), ("z", 0)), "k")}, batch="m")
    assert now() == [("x", 1), ("y", 3)] and now(version=one) == [("x", 1), ("y", 1), ("y", 2)]
    (tmp_path / "t" / "manifests" / f"{two + 1:012d}.json").write_text('{"vers')  # a driver was killed while writing it
    three = tables.commit(spark, root, {"a": tables.Change(None, rows(("x", 0)), "k")})
    assert three == two + 2 and now() == [("y", 3)]
    assert tables.commit(spark, root, {"a": tables.Change(rows(("y", 9)))}, batch="m") == two
    came, went = tables.changes(spark, root, "a", one)
    assert sorted(map(tuple, came.collect())) == [("y", 3)] and sorted(map(tuple, went.collect())) == [("x", 1), ("y", 1), ("y", 2)]
    tables.compact(spark, root, "a")
    assert now() == [("y", 3)] and now("b") == [("q", 1)] and tables.changes(spark, root, "a", one) is None
    tables.commit(spark, root, {"a": tables.Change(rows(("w", 5)), rows(("y", 0)), "k")})
    assert now() == [("w", 5)]
    tables.restore(spark, root, two)
    assert now() == [("x", 1), ("y", 3)]
    assert tables.vacuum(spark, root, keep=1) > 0 and now() == [("x", 1), ("y", 3)]


def test_runnable_jobs(spark):
    rows = [("a", "pending", None), ("b", "done", None), ("c", "processing", "2024-01-01 11:50:00"), ("d", "processing", "2024-01-01 10:00:00"), ("e", "processing", None)]
    jobs = spark.createDataFrame(rows, "job_id string, status string, s string").withColumn("processing_started_at", F.col("s").cast("timestamp"))
    assert {r.job_id for r in ingest.runnable(jobs, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()} == {"a", "d"}


def test_latest_states_and_replay(spark):
    events = spark.createDataFrame([("k", 1, 1, "a"), ("k", 2, 2, "b"), ("m", 1, 3, "c")], "key string, ts int, event_id int, phase string")
    states = progress.latest_states(events)
    assert {r.key: r.phase for r in states.collect()} == {"k": "b", "m": "c"}
    live = spark.createDataFrame([("k", 1, 1, "a"), ("k", 3, 4, "d")], "key string, ts int, event_id int, phase string")
    assert sorted(r.phase for r in progress.replay(states, live).collect()) == ["b", "c", "d"]


def plain_bucket(requests, rpm):
    state, out = {}, {}
    for k, t, i in sorted(requests):
        tokens, last = state.get(k, (rpm, t))
        tokens = min(rpm, tokens + (t - last) * rpm / 60)
        out[i] = tokens >= 1
        state[k] = (tokens - out[i], t)
    return out


def test_token_buckets(spark, tmp_path):
    requests = [(k, float((i * 7919) % 600) / (k + 1), k * 1000 + i) for k in range(4) for i in range(100)]
    rows = spark.createDataFrame(requests, "key long, seconds double, request_id long")
    expected = plain_bucket(requests, 3)
    assert {r.request_id: r.allowed for r in rate_limit.limited(rows, 3).collect()} == expected
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = rate_limit.limited_stream(stream, 3).writeStream.format("memory").queryName("buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.request_id: r.allowed for r in spark.table("buckets").collect()} == expected


def test_token_windows_with_a_public_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    text = " ".join(f"word{i}" for i in range(200))
    rows = K.token_windows(spark.createDataFrame([(text,), ("short",), (" ",)], "text string"), public.path("byte_bpe_50k.json"), size=64, overlap=16).collect()
    assert len([r for r in rows if r.text == text]) > 5 and [r.chunk for r in rows if r.text == "short"] == ["short"]


def test_token_counts_and_windows_of_a_plain_loop(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    texts = [" ".join(f"Wort{i * k % 97}," for i in range(k)) for k in (1, 5, 40, 300)] + ["", None, "東京 🙂"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = [len(plain.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n_tokens for r in K.token_counts(rows, path).orderBy("doc_id").collect()] == n
    found = {}
    for r in K.token_windows(rows, path, size=50, overlap=10).collect():
        found.setdefault(r.doc_id, {})[r.chunk_index] = r.chunk
    for i, t in enumerate(texts):
        ids = plain.encode(t or "", add_special_tokens=False).ids
        want = [t] if t and len(ids) <= 50 else [plain.decode(ids[s : s + 50]).strip() for s in range(0, max(0, len(ids) - 10), 40)]
        assert [found[i][k] for k in sorted(found.get(i, {}))] == (want if t else [])


def test_tokens_are_asked_for_once_a_word(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    bpe = pytest.importorskip("orrery.functions.bpe")
    path = public.path("byte_bpe_50k.json")
    plain, encode = tokenizers.Tokenizer.from_file(path), bpe.Encoder(path)
    plain.encode_special_tokens = True
    monkeypatch.setattr(encode, "asked", None)  # no Latin text goes through the whole tokenizer
    for text in ("Wort " * 1000, "it's  <|endoftext|> 12, é\n\n x", " a\tb "):
        assert len(encode(text)) // 4 == len(plain.encode(text, add_special_tokens=False).ids)
    assert len(encode.known) < 30
    call, (sent,) = encode.__reduce__()
    assert call is pickle.loads and call(sent)("a b") == encode("a b")
    assert bpe.Encoder(path).by_words and not bpe.cuts_words(json.loads(plain.to_str()) | {"normalizer": {"type": "Lowercase"}})


def test_windows_of_a_text_that_names_a_special_token(spark):
    public = pytest.importorskip("public_tokenizers")
    tokenizers = pytest.importorskip("tokenizers")
    path = public.path("byte_bpe_50k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    text = "one <|endoftext|> two " * 40
    ids = plain.encode(text, add_special_tokens=False).ids
    want = [plain.decode(ids[s : s + 50]).strip() for s in range(0, len(ids) - 10, 40)]
    rows = K.token_windows(spark.createDataFrame([(text,)], "text string"), path, size=50, overlap=10)
    assert [r.chunk for r in rows.orderBy("chunk_index").collect()] == want


def test_row_groups_of_a_key_in_many_slices(spark):
    rows = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), (1000 - F.col("id")).alias("o"), F.concat(F.lit("r"), "id").alias("text"))
    got = {(r.k, r.chunk_index): (r.row_range, r.total_rows, r.text) for r in K.row_groups(rows, "k", "o", size=7).collect()}
    for k in (0, 1):
        own = [f"r{i}" for i in range(999, -1, -1) if (i % 3 == 0) == bool(k)]
        for c in range(0, len(own), 7):
            part = own[c : c + 7]
            assert got[(k, c // 7)] == (f"{c}-{c + len(part) - 1}", len(own), "\n".join(part))
    assert len(got) == sum(-(-sum((i % 3 == 0) == bool(k) for i in range(1000)) // 7) for k in (0, 1))


def test_point_ids_and_metadata(spark):
    import uuid

    assert one(spark, X.point_id(F.lit("abc"))) == str(uuid.uuid5(uuid.NAMESPACE_OID, "abc"))
    meta = F.struct(F.lit("a").alias("filename"), F.lit(None).cast("string").alias("language"), F.array(F.lit("x")).alias("tags"))
    assert one(spark, X.encoded_metadata(meta)) == '{"filename":"a","tags":["x"]}'
    back = one(spark, X.decoded_metadata(X.encoded_metadata(meta), "filename string, language string, tags array<string>"))
    assert (back.filename, back.language, back.tags) == ("a", None, ["x"])


def test_many_sections_keep_their_order(spark, tmp_path):
    (tmp_path / "long.md").write_text("\n".join(f"# T{i}\n\nbody {i}" for i in range(3000)))
    found = files.with_document_id(files.files(spark, str(tmp_path)))
    rows = files.parse_files(found).orderBy("chunk_index").select("heading_path").collect()
    assert [r.heading_path for r in rows] == [f"T{i}" for i in range(3000)]


def test_few_files_are_sent_to_a_worker_at_a_time(spark, tmp_path, monkeypatch):
    from orrery.sources import files as source
    from orrery.sources import tables
    from orrery.streaming import ingest

    name, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", source.parsed
    seen = str(tmp_path / "seen")

    def parsed(found, **options):
        def counted(batches):
            for batch in batches:
                with open(seen, "a") as f:
                    f.write(f"{batch.num_rows}\n")
                yield batch

        return plain(found.mapInArrow(counted, found.schema), **options)

    monkeypatch.setattr(source, "parsed", parsed)
    before = spark.conf.get(name)
    new = spark.range(50, numPartitions=1).selectExpr("concat('/in/', id, '.txt') AS path", "concat(id, '.txt') AS filename", "CAST(concat('text ', id) AS binary) AS content")
    ingest.ingest(spark, new, str(tmp_path / "t"))
    assert spark.conf.get(name) == before and tables.read(spark, str(tmp_path / "t"), "chunks").count() == 50
    sizes = [int(x) for x in open(seen)]
    assert sum(sizes) == 50 and max(sizes) <= 16
