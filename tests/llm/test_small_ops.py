"""Exact dedup, mixing, chat, packing, secrets and fingerprints against plain Python on small tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmap.llm import chat, exact_dedup, merkle, mixing, packing, queries, secret_ledger
from weftmap.llm._bytes import chunks
from weftmap.llm._session import table


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_cuckoo_index_inserts_finds_deletes_and_grows():
    index = exact_dedup.CuckooIndex(buckets=2, bits=4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        assert index.find(k) is None
        index.insert(k, i)
    assert index.resizes > 3 and len(index) == 3000
    assert all(index.find(k)[1] == i for i, k in enumerate(keys))
    for k in keys[::2]:
        assert index.delete(k) and not index.delete(k)
    assert all((index.find(k) is None) == (i % 2 == 0) for i, k in enumerate(keys))


def test_exact_dedup_odd_rows(odd, nothing):
    rows = exact_dedup.exact_dedup(odd).collect()
    source = odd.collect()
    assert len(rows) == len(source)
    by = collections.defaultdict(list)
    for r in source:
        by[hashlib.sha256(norm(r.text).encode()).hexdigest()].append(r.doc_id)
    for r in rows:
        ids = by[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == min((i for i in ids if i is not None), default=None)
    kept = collections.Counter(r.text_sha256 for r in rows if r.kept)
    assert kept == dict.fromkeys(by, 1)
    assert sorted(norm(r.text) for r in exact_dedup.drop_copies(odd).collect()) == sorted({norm(r.text) for r in source})
    assert exact_dedup.drop_copies(odd).columns == odd.columns
    assert exact_dedup.exact_dedup(nothing).count() == 0 and exact_dedup.drop_copies(nothing).count() == 0


def test_exact_dedup_ids_and_contents(spark, monkeypatch):
    """The greatest id is an id, ids that are texts are refused, a digest alone makes no copy, and reruns choose the same row."""
    last = (1 << 63) - 1
    docs = spark.createDataFrame([(last, "only"), (-last - 1, "least"), (7, "a  b"), (last, "a b")], "doc_id long, text string")
    rows = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows == {(last, sha("only")): (last, 1, True), (-last - 1, sha("least")): (-last - 1, 1, True), (7, sha("a b")): (7, 2, True), (last, sha("a b")): (7, 2, False)}
    assert exact_dedup.drop_copies(docs).count() == 3
    with pytest.raises(TypeError):
        exact_dedup.exact_dedup(docs.withColumn("doc_id", docs["text"]))
    twice = spark.createDataFrame([(1, "x", s) for s in "bcda"] + [(2, "x", "e")], "doc_id long, text string, source string")
    assert len({tuple(exact_dedup.drop_copies(twice.repartition(n, "source")).collect()) for n in (1, 2, 5)}) == 1
    folder = exact_dedup.Folder()
    folder.add(b"\0" * 32, b"one", 1, 1)
    with pytest.raises(ValueError, match="share the digest"):
        folder.add(b"\0" * 32, b"two", 2, 1)


def test_exact_dedup_index_is_emptied(spark, monkeypatch):
    """Rows beyond the bound of live content leave in several partial rows and still meet."""
    import pyarrow as pa

    monkeypatch.setattr(exact_dedup, "LIVE", 2000)
    monkeypatch.setattr(exact_dedup, "chunks", lambda c: chunks(c, 500))
    texts = [f"text {i % 7} é" + "y" * 200 for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts)], names=["id", "text"])
    partial = pa.Table.from_batches(list(exact_dedup._fold([batch])))
    assert 7 < partial.num_rows < 100 and sum(partial["group_size"].to_pylist()) == 100
    met = pa.Table.from_batches(list(exact_dedup._meet(partial.sort_by("digest").to_batches()))).to_pylist()
    assert sorted((r["keep_id"], r["group_size"]) for r in met) == [(i, 15 if i < 2 else 14) for i in range(7)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab \t\n\x0b\x1cé", max_size=12)), max_size=6))
def test_normalised_bytes(texts):
    import pyarrow as pa

    got = [bytes(raw[a:b]).decode() for _, _, raw, at in exact_dedup.digests_of(pa.array(texts, pa.string())) for a, b in zip(at, at[1:])]
    assert got == [norm(t) for t in texts]


def waterfill(sizes, max_rate=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= max_rate * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = float(max_rate * sizes[s])
            left -= target[s]
        free -= over
    return target


@settings(max_examples=15, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("abcé", max_size=3)), st.integers(0, 5000), min_size=1, max_size=9))
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    expect = waterfill(sizes)
    assert {r.source: pytest.approx(r.target) for r in rows} == expect


def test_mixing(spark, sf_dir, odd, nothing):
    rows = queries.op4_mixing(spark, sf_dir).collect()
    taken, target = collections.Counter(), {}
    source = {r.doc_id: r.source for r in table(spark, sf_dir, "documents").collect()}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))
    assert sum(taken.values()) == pytest.approx(sum(target.values()), rel=0.25)
    planned = mixing.plan_mix(odd).collect()
    assert {(r.doc_id, r._wm_size) for r in planned} == {(r.doc_id, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in odd.collect()}
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.count() == sum(r._wm_copies for r in planned)
    assert mixing.mix(nothing).count() == 0


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a <|im_start|>x\\<|im_end|>"), (1, 2, "user", None), (1, 3, "assistant", ""),
        (2, 0, "system", "only \\\\<\\| \n"), (3, 5, "assistant", "é𝒳"), (3, 5, "assistant", "tie"), (3, 9, None, "t"),
        (None, 0, "assistant", "no conversation"), (4, None, "us\ner<", "<\\n"), (4, None, "assistant", "dup"), (4, None, "assistant", "dup"),
    ]
    turns = spark.createDataFrame([(*r, "extra", 7) for r in rows], "conv_id long, turn long, role string, text string, formatted string, n_turns int")
    examples = chat.format_chat(turns)
    for e in examples.collect():
        assert e.formatted.count(chat.START) == e.n_turns
        assert e.loss_start + e.loss_length <= len(e.formatted)
    got = {r.conv_id: r for r in chat.digest_chat(examples).collect()}
    by = collections.defaultdict(list)
    for c, k, role, text in rows:
        by[c].append((k is not None, k or 0, role or "", text or ""))
    for c, ts in by.items():
        ts.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in ts)
        loss = "".join(t for _, _, r, t in ts if r == "assistant")
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest_chat(chat.format_chat(turns.limit(0))).count() == 0


@settings(deadline=None)
@given(st.text("<|\\n\né a", max_size=20))
def test_escape_is_reversible(text):
    def esc(t):
        return t.replace("\\", "\\\\").replace("<|", "<\\|")

    assert "<|" not in esc(text)
    assert esc(text).replace("<\\|", "<|").replace("\\\\", "\\") == text


def test_best_fit_keeps_its_bound():
    bins = packing.BestFit(limit=100, max_open=5)
    used = collections.Counter()
    spans = collections.defaultdict(list)
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randint(1, 100)
        s, o = bins.place(n)
        spans[s].append((o, n))
        used[s] += n
        assert bins._open <= 5
    assert max(used.values()) <= 100
    for parts in spans.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n


def test_the_fullest_bin_closes_first():
    """Pieces in the order they come, with three open bins, step by step."""
    bins = packing.BestFit(limit=10, max_open=3)
    assert [bins.place(n) for n in (4, 7, 8)] == [(0, 0), (1, 0), (2, 0)]  # free: 6, 3, 2
    assert bins.place(9) == (3, 0)  # the bin with 2 free closes
    assert bins.place(2) == (1, 7)  # not (2, 8)
    assert bins.place(1) == (1, 9)  # least space remains in the bin with 1 free; it is full now
    assert bins.place(1) == (3, 9)
    rng, bins, most = random.Random(2), packing.BestFit(1024, packing.MAX_OPEN), 0
    total = 0
    for _ in range(20_000):
        n = int(min(1024, rng.lognormvariate(5.5, 1.0))) or 1
        bins.place(n)
        total += n
        most = max(most, bins._open)
    assert most == packing.MAX_OPEN and bins.sequences < 1.03 * total / 1024


def test_other_tokenizer_files_are_run_by_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, theirs = packing.Tokens(path), Tokenizer.from_file(path)
    assert not own.plain and TOKENS().plain
    for text in ("", "Some  Wörds, 12 of\tthem!", "<|im_end|>"):
        assert own(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("change", [("normalizer", {"type": "Lowercase"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True})])
def test_a_changed_tokenizer_file_is_not_taken_for_plain(tmp_path, change):
    import json

    from tokenizers import Tokenizer

    spec = json.load(open(queries.tokenizer_path())) | dict([change])
    (tmp_path / "t.json").write_text(json.dumps(spec))
    tokens, theirs = packing.Tokens(str(tmp_path / "t.json")), Tokenizer.from_file(str(tmp_path / "t.json"))
    assert not tokens.plain and tokens("Some Words HERE").tolist() == theirs.encode("Some Words HERE", add_special_tokens=False).ids


def test_packing(spark, odd, nothing):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    hf = Tokenizer.from_file(path)
    for docs in (odd, table(spark, "/root/testdata/sf0.001", "documents").limit(60)):
        rows = packing.pack(docs, path, with_ids=True).collect()
        texts = collections.defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(hf.encode(r.text or "", add_special_tokens=False).ids + [packing.CLOSING])
        got = collections.defaultdict(list)
        for r in rows:
            got[r.doc_id].append(r)
        assert set(got) == set(texts)
        for doc, ids in texts.items():
            pieces = sorted(got[doc], key=lambda r: (r.piece, r.sequence_id, r.offset))
            assert len(pieces) == sum(-(-len(x) // 1024) for x in ids)
            for r in pieces:
                assert list(r.ids) in [x[r.start : r.start + r.length] for x in ids]
                assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids))
        at = collections.defaultdict(list)
        for r in rows:
            at[r.sequence_id].append((r.offset, r.length))
        for parts in at.values():
            end = 0
            for o, n in sorted(parts):
                assert o == end
                end += n
            assert end <= 1024
        total = sum(r.length for r in rows)
        assert len(at) <= 1.2 * total / 1024 + 3 * docs.rdd.getNumPartitions()
    whole = {r.sequence_id: len(r.ids) for r in packing.sequences(packing.pack(odd, path, with_ids=True)).collect()}
    assert whole and max(whole.values()) <= 1024
    assert packing.pack(nothing, path).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_those_of_the_tokenizer(text):
    assert TOKENS()(text).tolist() == HF().encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000", "\x1c", " \t"])
def test_runs_of_over_a_million_blanks(blank):
    run = blank * (1_100_000 // len(blank))
    special = next(iter(TOKENS()._special))
    for text in (run, f"a{run}b", f"{run} 1{run}\n", f"a {run}{special}{run}. b", f"x{run}'s\x1f"):
        assert TOKENS()(text).tolist() == HF().encode(text, add_special_tokens=False).ids


def test_a_document_with_a_very_long_run_is_packed(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_100_000 + "b"), (2, "c")], "doc_id long, text string")
    rows = packing.pack(docs, queries.tokenizer_path()).collect()
    assert {r.doc_id: sum(x.length for x in rows if x.doc_id == r.doc_id) for r in rows} == {1: 1_100_002, 2: 2}


def TOKENS(kept=[]):
    if not kept:
        kept.append(packing.Tokens(queries.tokenizer_path()))
    return kept[0]


def HF(kept=[]):
    if not kept:
        from tokenizers import Tokenizer

        kept.append(Tokenizer.from_file(queries.tokenizer_path()))
    return kept[0]


def brute_spans(text):
    out = []
    for k, (pattern, group, least, flags) in enumerate(
        [(secret_ledger.ASSIGN, 2, 8, re.I | re.A), (secret_ledger.ACCESS, 0, 16, 0), (secret_ledger.HEX, 0, 32, 0)]
    ):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(out)


def test_secret_scan(spark, sf_dir, odd, nothing):
    for docs in (odd, table(spark, sf_dir, "documents")):
        ledger = secret_ledger.scan_unseen(docs).cache()
        assert ledger.count() == len({r.text or "" for r in docs.collect()})
        rows = secret_ledger.report(secret_ledger.findings(docs, ledger)).collect()
        expect = collections.Counter()
        for r in docs.collect():
            spans = brute_spans(r.text or "")
            written = ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in spans)
            n = collections.Counter(k for _, k, _ in spans)
            expect[(r.doc_id, n[0], n[1], n[2], hashlib.sha256(written.encode()).hexdigest())] += 1
        assert collections.Counter(tuple(r)[:5] for r in rows) == expect
        assert secret_ledger.scan_unseen(docs, ledger).count() == 0
    assert secret_ledger.findings(nothing, secret_ledger.scan_unseen(nothing)).count() == 0


def test_ledger_scans_unseen_pairs_only(spark, tmp_path, monkeypatch):
    """New texts, then a new version of a rule: each scan adds what it lacks, and findings are those of the present versions."""
    hexes = "0123456789abcdef" * 2
    docs = spark.createDataFrame([(1, f"a {hexes}"), (2, f"a {hexes}"), (3, "token = abcdefghij")], "doc_id long, text string")
    ledger = secret_ledger.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.rows() is None and ledger.scan(docs) == 2 and ledger.scan(docs) == 0
    more = docs.union(spark.createDataFrame([(4, f"é {hexes}{hexes}"), (5, None)], docs.schema))
    assert ledger.scan(more) == 2 and ledger.rows().count() == 4
    shown = lambda rules: {r.doc_id: r.spans for r in secret_ledger.report(secret_ledger.findings(more, ledger.rows(), rules=rules), rules=rules).collect()}
    old = {1: "hex:2:34", 2: "hex:2:34", 3: "assign:0:18", 4: "hex:2:66", 5: ""}
    assert shown(secret_ledger.RULES) == old
    rules = tuple(secret_ledger.Rule(**(r.__dict__ | {"version": 2, "least": 40})) if r.kind == "hex" else r for r in reversed(secret_ledger.RULES))
    assert ledger.scan(more, rules=rules) == 4 and ledger.scan(more, rules=rules) == 0
    assert {tuple(r.done) for r in ledger.rows().collect()[4:]} <= {("hex@2",), tuple(r.name for r in secret_ledger.RULES)}
    assert shown(rules) == old | {1: "", 2: ""} and shown(secret_ledger.RULES) == old


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text("ab .\n\té", max_size=80), st.integers(60, 140).map("same ".__mul__)), min_size=1, max_size=6))
def test_fingerprints_tell_texts_apart(texts):
    prints = merkle.fingerprints([t.encode() for t in texts])
    for a, p in zip(texts, prints):
        for b, q in zip(texts, prints):
            assert (a == b) == (p == q) == (merkle.likeness(p, q) == 1.0 and not merkle.differing(p, q) and not merkle.differing(q, p))
    alone = [merkle.fingerprints([t.encode()])[0] for t in texts]
    assert alone == prints == [plain_print(t.encode()) for t in texts]


M64 = (1 << 64) - 1


def mix64(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & M64
    h = (h ^ h >> 27) * 0x94D049BB133111EB & M64
    return h ^ h >> 31


def plain_hash(raw, lane):
    """What one substring's hash is, block by block."""
    seed = 0xA0761D6478BD642F * (2 * lane + 1) & M64
    total = 0
    for k in range(max(1, -(-len(raw) // 8))):
        block = int.from_bytes(raw[8 * k : 8 * k + 8], "little")
        total += mix64(block ^ seed) * (mix64(k * 0xD6E8FEB86659FD93 + seed & M64) | 1)
    return mix64(total + len(raw) * 0x8EBC6AF09C88C6E3 + seed & M64)


def plain_parent(children):
    return tuple(mix64(sum(mix64(c[lane] ^ mix64(k + 1)) for k, c in enumerate(children)) & M64) for lane in (0, 1))


def plain_print(raw):
    """One text's fingerprint: leaves, paragraphs, sections and root, one after the other."""
    spans = [m.span() for m in re.finditer(b"[^\x20\x09-\x0d]+", raw)] or ([(0, len(raw))] if raw else [])
    leaves, paragraphs, sections, body, begin, since = [], [], [], "", 0, 0
    for k, (a, b) in enumerate(spans):
        behind = spans[k + 1][0] if k + 1 < len(spans) else len(raw)
        ends = k + 1 == len(spans) or b"\n" in raw[b:behind]
        natural, since = ends or plain_hash(raw[a:b], 0) % merkle.LEAF_WORDS == 0, since + 1
        if natural or since % merkle.LONGEST_LEAF == 0:
            since = 0 if natural else since
            leaves.append(tuple(plain_hash(raw[begin:behind], lane) for lane in (0, 1)))
            body += f"{leaves[-1][0]:016x}"[: merkle.DIGITS]
            begin = behind
        if ends:
            paragraphs.append(plain_parent(leaves))
            leaves, body = [], body + ","
            if k + 1 == len(spans) or paragraphs[-1][0] % merkle.SECTION_PARAGRAPHS == 0:
                sections.append(plain_parent(paragraphs))
                paragraphs, body = [], body + "/"
    return hashlib.blake2b(b"".join(x.to_bytes(8, "little") for s in sections for x in s), digest_size=16).hexdigest() + ":" + body


def test_texts_that_polynomials_confuse():
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    a, b = a[:1024], a[1024:2048]
    assert a != b and len({plain_hash(t.encode(), 0) for t in (a, b)}) == 2
    prints = merkle.fingerprints([a.encode(), b.encode(), f"x {a} y".encode(), f"x {b} y".encode()])
    assert len({p[:32] for p in prints}) == 4 and merkle.likeness(prints[0], prints[1]) == 0.0


def test_an_inserted_paragraph_is_located():
    rng = random.Random(4)
    lines = [" ".join(f"w{rng.randrange(500)}" for _ in range(30)) for _ in range(40)]
    whole = merkle.fingerprints(["\n".join(lines).encode()])[0]
    for at in (0, 7, 39):
        more = merkle.fingerprints(["\n".join([*lines[:at], "quite new words stand in this line of text", *lines[at:]]).encode()])[0]
        n = sum(len(p) for s in merkle._tree(more) for p in s) - sum(len(p) for s in merkle._tree(whole) for p in s)
        found = merkle.differing(whole, more)
        assert 0 < len(found) <= n + 8 and sum(f[0] == "b" for f in found) - sum(f[0] == "a" for f in found) == n
        assert sorted((("ab"["ba".index(f[0])]), *f[1:]) for f in found) == sorted(merkle.differing(more, whole))
    x, y = (merkle.trees([t.encode()]) for t in ("\n".join(lines), "\n".join([*lines[:20], lines[20] + " more", *lines[21:]])))
    section, paragraph, leaf = x.first_difference(0, y, 0)
    tree = merkle._tree(x.prints[0])
    before = sum(len(s) for s in tree[:section]) + paragraph
    assert before == 20 and leaf == len(tree[section][paragraph]) - 1 and x.first_difference(0, x, 0) is None


def test_neighbours(spark, sf_dir, odd, nothing):
    for docs in (odd, table(spark, sf_dir, "documents")):
        rows = merkle.neighbours(docs).collect()
        source = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()), key=lambda r: (-r[0], -r[1], r[2]))
        got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in rows)
        expect = collections.Counter()
        near = {}
        for (known, doc, text), (_, _, after) in zip(source, source[1:] + source[:1]):
            half = len(text) // 2
            edited = text[: len(text) - half] + after[:half]
            p, q, n = merkle.fingerprints([text.encode(), edited.encode(), after.encode()])
            key = (doc if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), p, q)
            expect[key] += 1
            near[key] = (merkle.likeness(p, q), merkle.likeness(p, n))
        assert got == expect
        for r in rows:
            k = (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint)
            assert (r.edited_at is None) == (r.fingerprint[:32] == r.edited_fingerprint[:32])
            if got[k] == 1:
                assert (r.near_edited, r.near_next) == pytest.approx(near[k])
    long = [r for r in rows if r.n_chars > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.35
    assert sorted(r.near_next for r in long)[len(long) // 2] < 0.05
    assert merkle.neighbours(nothing).count() == 0
    assert merkle.neighbours(odd.limit(1)).count() == 1
