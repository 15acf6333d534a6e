"""The training-data operators against brute force, round trips and planted cases, with nulls, ties and empty tables."""

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tokenizers

from courtlens.llm import bpe, jaccard, langid, licenses, lsm, packing, perplexity, pii, shingles, tokenpack, urlmodel, wordbpe

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, (lang or {}).get(i, "en"), "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(n))


EDGES = [None, "", " \n\t", "a", "x" * 5000, "one two", "one two", "naïve café 中文  \n\n  ok"]


# --- op1 ----------------------------------------------------------------------------------------------------------
def test_bpe_is_that_of_the_library_and_decodes_to_the_text(spark):
    rng = random.Random(1)
    texts = [*EDGES, words(rng, 400), "  \n".join(words(rng, 3) for _ in range(60)), "a" * 300 + " " * 300 + "!?" * 200]
    df = docs(spark, texts).withColumnRenamed("lang", "ids")
    c = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    for chunk, overlap in ((bpe.CHUNK, bpe.OVERLAP), (100, 20), (64, 4)):
        got = {r.doc_id: (bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(bpe.encode(df, chunk=chunk, overlap=overlap)).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert np.frombuffer(got[i][0], "<u4").tolist() == c.short.encode_ordinary(t or "")
            assert got[i][1] == (t or "").encode()
    assert bpe.decode(bpe.encode(df.limit(0)), digests=True).collect() == []


def test_long_pieces_are_merged_as_short_ones():
    c = bpe.codec(bpe.default_ranks(), bpe.default_pattern())
    for t in ("a" * 4500, "the" * 1500, "x" * 4100 + " 12" + " " * 4200 + "!"):
        assert np.frombuffer(c.encode(t), "<u4").tolist() == c.short.encode_ordinary(t)


# --- op2 ----------------------------------------------------------------------------------------------------------
def _groups(texts):
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in by.values() for _, i in g}


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup(spark, collide):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    texts = [*EDGES, *(rng.choice(["a b", "ab", "a  b", "c", "cc", " d", "d ", None, "ef\x0bg", "efg", "e f g"]) for _ in range(150))]
    how = {"digest": lambda t: F.substring(F.sha2(t, 256), 1, 1), "memtable_bytes": 800, "most_runs": 2} if collide else {}
    got = {r.doc_id: r for r in lsm.assign(docs(spark, texts).withColumnRenamed("source", "digest").repartition(5), **how).collect()}
    want = _groups(texts)
    assert {i: (r.keep_id, r.group_size) for i, r in got.items()} == want
    assert all(r.kept == (i == want[i][0]) for i, r in got.items())
    assert lsm.assign(docs(spark, texts).limit(0)).collect() == []


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup_keeps_one_row_of_each_text(spark, collide):
    from pyspark.sql import functions as F

    table = [(0, "ab"), (1, "ab"), (1, "cd"), (1, "cd"), (1, "c d"), (1, "cd "), (2, None), (2, ""), (None, "x"), (None, "x"), (3, "x" * 9)]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(table)], "doc_id long, text string, ties int").repartition(3)
    how = {"digest": lambda t: F.substring(F.sha2(t, 256), 1, 1), "memtable_bytes": 300, "most_runs": 2} if collide else {}
    got = lsm.deduplicate(df, **how)
    assert got.columns == df.columns
    found = [(r.doc_id, r.text) for r in got.collect()]
    assert len(found) == 5 and {(0, "ab"), (None, "x"), (3, "x" * 9)} < set(found) and len(set(found) & {(1, "c d"), (1, "cd ")}) == 1 and len(set(found) & {(2, None), (2, "")}) == 1
    assert lsm.deduplicate(df.limit(0)).collect() == []


def test_merge_index_finds_flushed_rows():
    index = lsm.MergeIndex(memtable_bytes=500, most_runs=3)
    out = []
    for i in range(200):
        t = str(i % 40).encode()
        out += index.put(hashlib.sha256(t).hexdigest(), lsm.Entry(len(t), i, 1, t))
    out += index.compact()
    total = Counter()
    for d, e in out:
        total[d] += e.count
    assert sorted(total.values()) == [5] * 40
    assert lsm.Bloom(["a", "b"]).__contains__("a")


# --- op3 ----------------------------------------------------------------------------------------------------------
def test_url_rules_and_verdicts(spark):
    urls = ["http://a.example.org/es/1", "http://example.org/en/12?x=/y", "https://example.ORG/en/2", "http://b.com/fr/1#t", "http://b.com/de/", "http://b.com", "nothing", None, "", "http://x.net/good", "http://org", "x://comx/fr/", "http://q.com/de/zzz", "http://q.com/fr/aaa"] * 3
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, score string")
    got = {r.page_id: r for r in urlmodel.filter_urls(df).collect()}
    assert len(got) == len(urls)
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (0, 1, 2, 3, 4)] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"),
        ("b.com", "/fr/1", "com/fr/", "allow"), ("b.com", "/de/", "com/de/", "block"),
    ]
    assert [(got[i].host, got[i].path, got[i].rule) for i in (5, 6, 7, 8, 10, 11)] == [("b.com", "", None), ("", "", None), ("", "", None), ("", "", None), ("org", "", None), ("comx", "/fr/", None)]
    assert all(r.verdict in ("allow", "block") for r in got.values())
    assert urlmodel.filter_urls(df.limit(0)).collect() == []
    assert {r.verdict for r in urlmodel.filter_urls(df.where("page_id = 9")).collect()} == {"allow"}

def test_url_model_learns_from_long_contexts_and_numbers(spark):
    rng = random.Random(3)

    tails = ["".join(rng.choices("abcdef", k=4)) + str(i) for i in range(400)]
    urls = [f"http://example.org/{'en/1' if i % 2 else 'en/2'}/{t}" for i, t in enumerate(tails)] + [f"http://other.net/{w}/{t}" for t in tails[:20] for w in ("en/1", "en/2")]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = (("allow", "org", "/"), ("block", "example.org", "/en/1"))
    got = [r.score for r in sorted(urlmodel.filter_urls(df, rules=rules).collect()) if r.rule is None]
    assert len(got) == 40
    assert all(one < two for one, two in zip(got[::2], got[1::2], strict=True))  # the same url but for the digit


def test_url_model_scores_are_those_of_brute_force(spark):
    rng = random.Random(4)
    urls = ["http://" + rng.choice(("a.org", "b.example.org", "é.com", "q.net")) + rng.choice(("/en/1", "/es/", "/fr/", "/de/", "/x")) + "".join(rng.choices("ab1中2", k=5)) for _ in range(80)]
    got = sorted(urlmodel.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect())
    held = {r.url for r in spark.createDataFrame([(u,) for u in urls], "url string").where("pmod(xxhash64(url), 4) = 0").collect()}
    models = []
    for verdict in ("allow", "block"):
        following = defaultdict(Counter)
        for r, u in zip(got, urls, strict=True):
            if r.rule is not None and r.verdict == verdict and u not in held:
                s = "\0" * urlmodel.ORDER + u + "\0"
                for i in range(urlmodel.ORDER, len(s)):
                    for k in range(urlmodel.ORDER + 1):
                        following[s[i - k : i]][s[i]] += 1
        models.append(following)

    def log_p(following, context, symbol):
        p = 1 / urlmodel.SIZE
        for k in range(len(context) + 1):
            f = following.get(context[len(context) - k :])
            if f:
                p = (f[symbol] + len(f) * p) / (sum(f.values()) + len(f))
        return np.log(p)

    for r, u in zip(got, urls, strict=True):
        s = "\0" * urlmodel.ORDER + u + "\0"
        want = [log_p(models[0], s[i - urlmodel.ORDER : i], s[i]) - log_p(models[1], s[i - urlmodel.ORDER : i], s[i]) for i in range(urlmodel.ORDER, len(s))]
        assert r.score == pytest.approx(np.mean(want), abs=1e-9)


# --- op4 ----------------------------------------------------------------------------------------------------------
def test_word_ids_are_those_of_the_library():
    rng = random.Random(4)
    c = wordbpe.codec(wordbpe.default_path())
    library = tokenizers.Tokenizer.from_file(wordbpe.default_path())
    assert np.frombuffer(c.encode("a <|endoftext|> b<|startoftext|>"), "<u4").tolist() == [320, 49407, 321, 49406]
    parts = [" ", "\n", "A", "é", "'s", "'RE", "1", "!", "　", "\x1c", "ab", "中", "\xa0", "<|endoftext|>", "<|", "<|startoftext|>", "<|ENDOFTEXT|>", "|>", "é", "İ", "½", "th", "\x85", "_"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 15)))
        assert np.frombuffer(c.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_is_gapless_whole_and_tight(spark):
    rng = random.Random(5)
    texts = [*EDGES, *(words(rng, rng.randint(1, 60)) for _ in range(150)), words(rng, 700)]
    got = packing.pack(docs(spark, texts).withColumnRenamed("lang", "offset").repartition(4), capacity=256).collect()
    c = wordbpe.codec(wordbpe.default_path())
    end = np.array([1], "<u4").tobytes()
    for i, t in enumerate(texts):
        ids = c.encode(t or "") + end
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[a : a + 1024]) for a in range(0, len(ids), 1024)]
        assert [r.start for r in own] == [256 * k for k in range(len(own))]
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack(docs(spark, texts).limit(0)).collect() == []


def test_two_smaller_pieces_replace_a_small_one():
    assert [p for _, p in packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)][0] == [(6, 1), (2, 2)]


# --- op5 ----------------------------------------------------------------------------------------------------------
def test_plain_spans_are_those_of_the_patterns():
    rng = random.Random(6)

    def brute(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub(r"\D", "", m.group())) <= 19 and pii.luhn(d)]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m.group())) <= 15]

    parts = ["a", "b.", "@", "1", "2", "12", ".", "255", "+", " ", "-", "(", ")", "4111111111111111", "%", "c-d", "@x.y"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert sorted(brute(t)) == sorted(pii.plain(t)), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail john.smith [at] example [dot] com now", "email", "john.smith [at] example [dot] com"),
        ("john dot smith at example dot com", "email", "john dot smith at example dot com"),
        ("jоhn@ехample.com", "email", "jоhn@ехample.com"),
        ("call plus one five five five eight two three four five six seven", "phone", "plus one five five five eight two three four five six seven"),
        ("ip 192[.]168[.]1[.]1 x", "ip", "192[.]168[.]1[.]1"),
        ("write to jane @ example.com today", "email", "jane @ example.com"),
        ("write to jane@ example.com today", "email", "jane@ example.com"),
        ("x " + "j" * 900 + " (at) example.com", "email", "j" * 900 + " (at) example.com"),
        ("a dot b dot c_at_host dot org", "email", "a dot b dot c_at_host dot org"),
        ("４１１１１１１１１１１１１１１１", "card", "４１１１１１１１１１１１１１１１"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ],
)
def test_disguised_spans(text, kind, found):
    assert (kind, found) in [(k, text[a:b]) for k, a, b, _ in pii.spans(text)]


@pytest.mark.parametrize("text", [" ", "<", "< ", "@", "at ", " at a.b", "a@b.c ", "1[.]1[.]1[.]1 ", "a dot ", "x [at] y.z ", "+1 ", "1", "1 ", "1.", "plus one two ", "one two three four ", "é@", "ａ@b.ｃ "])
def test_personal_data_is_sought_in_linear_time(text):
    long = text * (400_000 // len(text))
    began = time.process_time()
    pii.mask(long)
    assert time.process_time() - began < 30


def test_mapped_spans_are_those_of_brute_force():
    rng = random.Random(8)
    parts = ["a", "b.c", " at ", " dot ", "@", " @ ", "[at]", " (dot) ", "x.org", "1", "one two three four five ", "[.]", "255", " ", "é", "о", "4111 1111 1111 1111", "+1 555 555 1234"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        found = pii.spans(t)
        base = pii.plain(t)
        assert {s[:3] for s in found if s[3]} == set(base)
        for kind, a, b, plain in found:
            assert 0 <= a < b <= len(t) and (plain or not any(k == kind and x <= a and b <= y for k, x, y in base))


def test_clean_texts_have_no_spans_and_columns_survive(spark):
    for t in ("look at example.com", "the dot at the end", "un un un un un un un un un un un un un un un un", "one two three", "+12", "1.2.3"):
        assert pii.spans(t) == [], t
    df = docs(spark, ["write to a.b@c.de or +1 (555) 555-1234!", None, "", "clean"]).withColumnRenamed("source", "spans")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[0].text == "write to <EMAIL> or <PHONE>!" and got[0].n_chars == len(got[0].text)
    assert got[1].text is None and got[2].text == "" and got[3].text == "clean"
    found = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert [(s.kind, s.start, s.end) for s in found[0]] == [("email", 9, 17), ("phone", 21, 38)] and found[1] == []


# --- op6 ----------------------------------------------------------------------------------------------------------
def test_languages(spark):
    rng = random.Random(7)
    alphabets = {"en": "thewand", "de": "diernuß", "fr": "leséuxo", "es": "losañdc"}
    texts, lang = [], {}
    for i in range(240):
        k = sorted(alphabets)[i % 4]
        lang[i] = k
        texts.append(words(rng, 40, alphabets[k]))
    df = docs(spark, texts, lang)
    model = langid.train(df.where("doc_id < 160"))
    got = langid.identify(df, model).where("doc_id >= 160").collect()
    assert sum(lang[r.doc_id] == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    und = langid.identify(docs(spark, [None, "", "123 !?"]), model).collect()
    assert {(r.lang_pred, r.score) for r in und} == {("und", 0.0)}
    assert langid.train(df.limit(0)) is None and langid.identify(df.limit(1), None).first().lang_pred == "und"
    assert langid.identify(df.limit(1), langid.train(df.where("lang = 'fr'"))).first().lang_pred == "fr"


def test_votes_are_those_of_brute_force():
    rng = random.Random(19)
    alphabets = {"en": "thewand", "de": "diernuß", "nl": "hetvand", "fr": "leséuxo", "es": "losañdc", "it": "chelado"}
    known = [(k, langid.vector(words(rng, 30, a))) for k, a in alphabets.items() for _ in range(12)]
    model = langid.Identifier(np.stack([v for _, v in known]), [k for k, _ in known])
    dot = lambda w, v: sum(float(a) * float(b) for a, b in zip(w, [*v, 1.0], strict=True) if b)
    for _ in range(60):
        v = langid.vector(words(rng, 6, "".join(alphabets.values())))
        margins = {f: dot(w, v) for f, w in zip(model.families, model.by_family, strict=True)}
        family = max(margins, key=margins.get)
        members = [k for k in sorted(alphabets) if langid.family(k) == family]
        votes, sums = Counter(), Counter()
        for a, b in [(a, b) for a in members for b in members if a < b]:
            m = dot(model.pairs[a, b], v)
            votes[a if m >= 0 else b] += 1
            sums[a] += m
            sums[b] -= m
        assert model.predict(v)[0] == min(members, key=lambda k: (-votes[k], -sums[k], k))


# --- op7 ----------------------------------------------------------------------------------------------------------
def test_token_rows_hold_every_text(spark):
    rng = random.Random(8)
    texts = [*EDGES, *(words(rng, rng.randint(1, 80)) for _ in range(60)), words(rng, 900)]
    got = tokenpack.pack_rows(docs(spark, texts).withColumnRenamed("lang", "row"), row=128, lot_tokens=3000).collect()
    c = bpe.codec(tokenpack.default_ranks(), bpe.default_pattern())
    pieces = defaultdict(dict)
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u2")
        assert len(ids) == 128 and r.cu_seqlens[-1] == r.n_tokens and (ids[r.n_tokens :] == len(c.bytes_of)).all()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            pieces[d][s] = ids[a:b]
        at = tokenpack.position_ids(r.starts, r.cu_seqlens, 128)
        assert [at[a] for a in r.cu_seqlens[:-1]] == r.starts
    for i, t in enumerate(texts):
        own = [x for _, x in sorted(pieces[i].items())]
        assert (np.concatenate(own).tolist() if own else []) == np.frombuffer(c.encode(t or ""), "<u4").tolist()


def test_token_rows_are_written_as_matrices(spark, tmp_path):
    rng = random.Random(9)
    texts = [words(rng, rng.randint(1, 80)) for _ in range(40)]
    path = str(tmp_path / "rows")
    tokenpack.write_rows(tokenpack.pack_rows(docs(spark, texts), row=64), path)
    read = spark.read.parquet(path).orderBy("part", "row").collect()
    m = tokenpack.matrix([bytes(r.ids) for r in read], 64)
    assert m.shape == (len(read), 64) and m.dtype == np.dtype("<u2")
    c = bpe.codec(tokenpack.default_ranks(), bpe.default_pattern())
    assert sum(r.n_tokens for r in read) == (m != len(c.bytes_of)).sum() == sum(len(c.encode(t)) // 4 for t in texts)


def test_best_fit_decreasing():
    rng = random.Random(9)
    for _ in range(100):
        cap = rng.choice([1, 5, 8, 16, 31])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 40))]
        room = []
        for n in sorted(lengths, reverse=True):
            fits = [(r, k) for k, r in enumerate(room) if r >= n]
            if fits:
                room[min(fits)[1]] -= n
            else:
                room.append(cap - n)
        rows, n = tokenpack.best_fit_decreasing(lengths, cap)
        assert n == len(room) and sorted(i for r in rows for i in r) == list(range(len(lengths)))


# --- op8 ----------------------------------------------------------------------------------------------------------
def _components(texts, width, num, den):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * den >= (len(sets[i] | sets[j])) * num:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("width", "num", "den", "block"), [(3, 90, 100, 2048), (5, 8, 10, 16)])
def test_jaccard_components(spark, monkeypatch, width, num, den, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", 4)
    rng = random.Random(10)
    base = [words(rng, rng.randint(20, 150)).split() for _ in range(12)]
    shared = words(rng, 60)
    texts = list(EDGES)
    for _ in range(260):
        w = list(rng.choice(base[:3] if rng.random() < 0.6 else base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = words(rng, 1, "xyz")
        texts.append(" ".join(w) if rng.random() < 0.8 else shared + " " + " ".join(w[:30]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs(spark, texts).withColumnRenamed("lang", "token").repartition(5), width=width, num=num, den=den).collect()}
    assert got == _components(texts, width, num, den)
    assert jaccard.join(docs(spark, []), width=width, num=num, den=den).collect() == []


def test_bitmaps_bound_the_difference_from_below():
    rng = np.random.default_rng(1)
    for n in (20, 300, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 20 :], rng.integers(0, 2**63, n // 10, dtype=np.uint64)]))
        assert jaccard.differing(jaccard.bitmap(a, 9, 10), jaccard.bitmap(b, 9, 10)) <= len(np.setxor1d(a, b))


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    texts = [*EDGES, "thequickbrown foxjumpsover  the lazy doggggggggggggggg", " Ab\tCD\nlonglonglonglongword ", "aaaaaaabbbbbbb cc", "aaaaaa bbbbbbb ccccccc", "naïve É É"]
    found, named = [], {}
    for chunk in (1, 5, 7, 1 << 18):
        monkeypatch.setattr(shingles, "CHUNK", chunk)
        shingles._tables.cache_clear()
        found.append({low + i: h[bounds[i] : bounds[i + 1]].tolist() for low, h, bounds in shingles.words(pa.array(texts)) for i in range(len(bounds) - 1)})
    shingles._tables.cache_clear()
    assert all(f == found[0] for f in found)
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        assert len(w) == len(found[0][i]) and all(named.setdefault(x, h) == h for x, h in zip(w, found[0][i], strict=True))
    assert len(set(named.values())) == len(named)


def test_near_dedup_keeps_one_row_of_each_component(spark):
    rng = random.Random(12)
    a, b, c = (words(rng, 60) for _ in range(3))
    near = a + " tail"
    table = [(1, a, "en"), (1, a, "en"), (1, a, "fr"), (0, near, "en"), (2, b, "en"), (2, c, "en"), (2, c, "en"), (3, c, "en"), (None, a, "en"), (4, None, "en"), (5, "", "en"), (4, None, "en")]
    df = spark.createDataFrame([(i, t, g, 1, "x") for i, t, g in table], "doc_id long, text string, lang string, sig int, th string")
    got = sorted(((r.doc_id, r.text) for r in jaccard.deduplicate(df).collect()), key=str)
    assert got == sorted([(0, near), (2, b), (2, c), (None, a), (4, None), (4, None), (5, "")], key=str)
    assert jaccard.deduplicate(df).columns == df.columns
    assert jaccard.deduplicate(df.limit(0)).collect() == []


# --- op9 ----------------------------------------------------------------------------------------------------------
def test_licenses(spark):
    texts = [None, "", "no notice here", "x\nReleased under the MIT License.\ny", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public Licence, version 3.", "Licensed under CC BY-NC 4.0. All else is prose.", "a driving licence was lost"]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts).withColumnRenamed("lang", "license")).collect()}
    assert {i: (r.license, r.verdict) for i, r in got.items()} == {3: ("MIT", "exact"), 4: ("Apache-2.0", "exact"), 5: ("GPL-3.0", "modified"), 6: ("CC-BY-NC-4.0", "exact")}
    assert texts[3][got[3].start : got[3].end] == "Released under the MIT License"
    assert licenses.scan(docs(spark, [])).collect() == []

def test_wrapped_licenses_are_found_whole():
    for name, no in (("MIT", 2), ("GPL-3.0", 1), ("GPL-2.0", 1), ("Apache-2.0", 1), ("MPL-2.0", 0)):
        text = "\n * ".join(textwrap.wrap(licenses.TEMPLATES[name][no], 78))
        assert [(f[2], f[6]) for f in licenses.notices(f"Copyright (c) 2020 Ann\n\n * {text}\n\nint main() {{}}")] == [(name, "exact")], name
    assert [f[2] for f in licenses.notices("All rights\nreserved.")] == ["Proprietary"]

def test_every_template_is_found_in_a_long_line():
    rng = random.Random(9)
    prose = words(rng, 3000, "bcdefgh")
    for name, texts in licenses.TEMPLATES.items():
        for no, notice in enumerate(texts):
            text = f"{prose} {notice} {prose}"
            assert [(f[2], f[3], f[6]) for f in licenses.notices(text)] == [(name, no, "exact")], (name, no)

def test_equal_places_go_to_the_first_name(monkeypatch):
    monkeypatch.setitem(licenses.TEMPLATES, "Zzz", ("Licensed under the MIT License.",))
    licenses._templates.cache_clear()
    found = licenses.notices("Licensed under the MIT License.")
    licenses._templates.cache_clear()
    assert [f[2] for f in found] == ["MIT"]


def test_notices_are_those_of_brute_force():
    """Every place of every template in a short text, without hits, windows or compression."""
    rng = random.Random(18)
    short = [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts if len(t) < 120]
    for _ in range(150):
        parts = [rng.choice([t for _, t in short]) if rng.random() < 0.5 else words(rng, rng.randint(8, 15)) for _ in range(rng.randint(1, 4))]
        text = rng.choice([" ", "\n", "\n// "]).join(parts)
        got = licenses.notices(text)
        low = [w.lower() for w in licenses._WORD.findall(text)]
        for p in parts:
            names = {n for n, t in short if t == p}
            own = [w.lower() for w in licenses._WORD.findall(p)]
            places = sum(low[i : i + len(own)] == own for i in range(len(low)))
            if names:
                assert sum(f[2] in names and f[6] == "exact" for f in got) >= 1 and places >= 1, (p, got)
        assert len(got) == sum(any(t == p for _, t in short) for p in parts), (parts, got)


def test_each_notice_of_a_block_is_reported():
    text = "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License. All rights reserved."
    found = licenses.notices(text)
    assert [(f[2], f[6]) for f in found] == [("Apache-2.0", "exact"), ("MIT", "exact"), ("Proprietary", "exact")]
    assert [text[f[0] : f[1]] for f in found] == ["Licensed under the Apache License, Version 2.0", "Released under the MIT License", "All rights reserved"]
    assert len(licenses.notices("All rights reserved. Page of a book. " * 30)) == 30
    two, three = licenses.TEMPLATES["BSD-2-Clause"][1], licenses.TEMPLATES["BSD-3-Clause"][1]
    for text, name in ((two, "BSD-2-Clause"), (three, "BSD-3-Clause"), (three.replace("the copyright holder nor", "Example nor"), "BSD-3-Clause")):
        assert [f[2] for f in licenses.notices("\n".join(textwrap.wrap(text, 78)))] == [name]


# --- op10 ---------------------------------------------------------------------------------------------------------
def test_plain_counts_of_a_text():
    rng = random.Random(11)
    for _ in range(500):
        t = "".join(rng.choice(["a", "b", " ", "  ", "\n", "#", "é", "\x0b", "a b a b a b\n", "$$"]) for _ in range(rng.randint(0, 60)))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
            seen.add(line)
        assert perplexity.plain_counts(t) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)), repr(t)


def test_plain_counts_tell_capitals_from_small_letters(spark):
    five = "one two three four five"
    want = {f"{five} {five}": 10, f"{five} {five.title()}": 0, f"{five} ONE two three four five {five}": 10, f"{'x' * 300_000} {five} {five.upper()}": 0}
    assert {t: perplexity.plain_counts(t)[4] for t in want} == want
    got = [(r.n_words, r.n_repeat_words, r.base_failed) for r in perplexity.judge(docs(spark, [f"{five} {five}", f"{five} {five.title()}"])).orderBy("doc_id").collect()]
    assert got == [(10, 10, True), (10, 0, False)]


def _kneser_ney(texts, order):
    """p(symbol | context) by the textbook, over strings."""
    pad = "\0" * (order - 1)
    top = Counter(t[i - order + 1 : i + 1] for t in (pad + t for t in texts) for i in range(order - 1, len(t)))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {k: perplexity.discounts([sum(c == i for c in levels[k].values()) for i in (1, 2, 3, 4)]) for k in levels}

    def p(context, symbol):
        k = len(context) + 1
        lower = p(context[1:], symbol) if context else 1 / perplexity.SYMBOLS
        own = {g: n for g, n in levels[k].items() if g[:-1] == context}
        if not own:
            return lower
        n = own.get(context + symbol, 0)
        total = sum(own.values())
        return (n - (cut[k][min(n, 3) - 1] if n else 0)) / total + sum(cut[k][min(c, 3) - 1] for c in own.values()) / total * lower

    return p


@pytest.mark.parametrize("shard_bytes", [1, 1 << 25])
def test_perplexities_are_those_of_brute_force(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(perplexity, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(perplexity, "BUFFER", 200)
    rng = random.Random(14)
    texts = [" ".join(rng.choices("the cat sat on a mat é 中文 💡 zzq".split(), k=rng.randint(1, 40))) for _ in range(24)] + [None, ""]
    df = docs(spark, texts, {i: "fr" if i % 2 else "en" for i in range(len(texts))}).repartition(3)
    halves = {r.doc_id: (r.half, r.lang) for r in perplexity._source(df, "doc_id", "text", "lang").collect()}
    models = {(h, g): _kneser_ney([texts[i] for i, x in halves.items() if x == (h, g) and texts[i]], perplexity.ORDER) for h, g in set(halves.values())}
    got = {r.doc_id: r for r in perplexity.judge(df).collect()}
    for i, (half, lang) in halves.items():
        if not texts[i]:
            assert got[i].perplexity is None
            continue
        p, t = models[1 - half, lang], "\0" * (perplexity.ORDER - 1) + texts[i]
        want = np.exp(-np.mean([np.log(p(t[k - perplexity.ORDER + 1 : k], t[k])) for k in range(perplexity.ORDER - 1, len(t))]))
        assert got[i].perplexity == pytest.approx(want, rel=1e-4)


def test_quality_keeps_prose_and_rejects_noise(spark):
    rng = random.Random(12)
    vocabulary = words(rng, 300, "theandorsi").split()
    terms = ["".join(rng.choices("theandorsi", k=80)) for _ in range(10)]
    good = [" ".join([*rng.choices(vocabulary, k=rng.randint(40, 200)), *rng.sample(terms, 2)]) for _ in range(80)]
    codes = " ".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=30)) for _ in range(30))
    regular = " ".join(terms)
    noise = ["$$$ " * 300 + "a b c d e f g h i j", codes, regular]
    df = docs(spark, [*good, *noise, None, "", "too short"], {0: None}).withColumnRenamed("source", "kept")
    got = {r.doc_id: r for r in perplexity.judge(df).collect()}
    assert all(got[i].kept for i in range(80)) and got[0].perplexity is None
    assert all(r.kept == (not r.base_failed and (r.perplexity is None or r.lower <= r.perplexity <= r.upper)) for r in got.values())
    assert got[81].perplexity > got[81].upper and not got[81].base_failed and got[82].perplexity < got[82].lower
    assert all(not got[i].kept for i in range(80, 86)) and all(got[i].base_failed for i in (80, 83, 84, 85))
    assert perplexity.judge(docs(spark, [])).collect() == []


def test_rows_are_accepted_by_their_own_text(spark):
    rng = random.Random(15)
    vocabulary = words(rng, 300, "theandorsi").split()
    prose = [" ".join(rng.choices(vocabulary, k=90)) for _ in range(30)]
    table = [*((i, t, "en") for i, t in enumerate(prose)), (1, "bad", "en"), (1, prose[1], "en"), (None, prose[2], None), (None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in table], "doc_id long, text string, lang string, th int")
    got = perplexity.accept(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([*enumerate(prose), (1, prose[1]), (None, prose[2])], key=str)


# --- edges of all operators ------------------------------------------------------------------------------------
OPERATORS = {
    "bpe": (lambda df: bpe.decode(bpe.encode(df), digests=True), "doc_id", 1),
    "exact": (lsm.assign, "doc_id", 1),
    "exact dedup": (lsm.deduplicate, "doc_id", 0),
    "urls": (lambda df: urlmodel.filter_urls(df, id_col="doc_id", url_col="text"), "page_id", 1),
    "packing": (packing.pack, "doc_id", 0),
    "personal data": (pii.find, "doc_id", 1),
    "redaction": (pii.redact, "doc_id", 1),
    "language": (lambda df: langid.identify(df, langid.train(df)), "doc_id", 1),
    "token rows": (tokenpack.pack_rows, None, 0),
    "near": (jaccard.join, "doc_id", 1),
    "near dedup": (jaccard.deduplicate, "doc_id", 0),
    "licenses": (licenses.scan, "doc_id", 0),
    "quality": (perplexity.judge, "doc_id", 1),
    "quality filter": (perplexity.accept, "doc_id", 0),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_are_taken_by_every_operator(spark, name):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing columns, an empty table."""
    operator, key, a_row = OPERATORS[name]
    rng = random.Random(16)
    long = " ".join(words(rng, 9) for _ in range(4000)) + " Licensed under the MIT License. a@b.cd"
    texts = [None, "", "   ", "é", "中文", long, "\0", "http://a.org/x", "word " * 30, "x" * 30_000, "a@b.cd " * 50, "Licensed under the MIT License."]
    table = [(i, t, "en" if i % 2 else "fr", None if i % 3 else "s", None if i % 2 else 1) for i, t in enumerate(texts)]
    table += [table[5], table[5], table[8], (1, "other text with the same id", None, None, None), (None, long, None, None, None), (None, None, None, None, None)]
    clash = "kept spans score digest th n sig token row half lang_pred n_words piece sequence_id rule verdict component_id class_id _id ids key size".split()
    df = spark.createDataFrame([(*r, *[None] * len(clash)) for r in table], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in clash)).repartition(3)
    if name == "redaction" or name.endswith(("dedup", "filter")):
        assert operator(df).columns == df.columns
    got = operator(df).collect()
    if a_row:
        assert Counter(r[key] for r in got) == Counter(r[0] for r in table)
    elif key:
        assert {r[key] for r in got} <= {r[0] for r in table}
    assert operator(df.limit(0)).collect() == []
    lone = operator(df.where("text is null"))
    assert len(lone.collect()) >= a_row


# --- pipeline -----------------------------------------------------------------------------------------------------
def test_pipeline_takes_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(17)
    vocabulary = words(rng, 300, "theandorsi").split()
    prose = [" ".join(rng.choices(vocabulary, k=80)) for _ in range(30)]
    long = " ".join(rng.choices(vocabulary, k=9000))
    table = [*enumerate(prose), (0, prose[0]), (3, prose[3]), (3, long), (None, prose[4]), (None, None), (5, ""), (6, None)]
    df = spark.createDataFrame([(i, t, "en", None, None, "x") for i, t in table], SCHEMA + ", th string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = Counter((r.doc_id, r.piece) for r in got)
    assert {d for d, _ in pieces} >= set(range(30)) and all(pieces[i, 0] == 1 for i in range(30) if i != 3) and pieces[3, 0] == 2
    assert (3, 1) in pieces and None not in {d for d, _ in pieces}
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_pipeline_on_a_small_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(13)
    vocabulary = words(rng, 300, "theandorsi").split()
    texts = [" ".join(rng.choices(vocabulary, k=80)) for _ in range(40)]
    texts += [texts[0], texts[1] + " ", " ".join([*texts[2].split()[:-1], "changed"]), texts[3] + " mail a@b.cd", "short", None]
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r.doc_id for r in got}
    assert kept.isdisjoint({40, 44, 45}) and (0 in kept) and len(kept & {1, 41}) == 1 and len(kept & {2, 42}) == 1 and len(kept & {3, 43}) == 1
    assert kept >= set(range(4, 40))
