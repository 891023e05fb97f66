"""Each operator on edge cases, empty tables, and against brute force or exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lemmata.llm import ann, binary, decontam, jaccard, lines, mixing, pii, token_counts, tokenize, toxicity, urls
from tests.llm.conftest import split_words


def rows(df):
    return [r.asDict() for r in df.collect()]


def some_docs(spark, n=120, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[r.choice(vocabulary) for _ in range(r.choice([3, 5, 6, 9, 14, 40, 90]))] for _ in range(n)]
    for _ in range(n):
        t = list(r.choice(texts))
        for _ in range(r.choice([0, 1, 1, 2])):
            t[r.randrange(len(t))] = r.choice(vocabulary)
        texts.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(texts)], spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


def test_jaccard_against_brute_force(spark):
    docs, df = some_docs(spark)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in rows(jaccard.jaccard_join(df))}
    assert got == brute_components(docs)


def test_jaccard_edges(spark, edge_docs, empty_docs):
    got = rows(jaccard.jaccard_join(edge_docs))
    assert len(got) == 9
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert all(r["component_id"] == r["doc_id"] and r["n_links"] == 0 for r in got if r["doc_id"] in (3, 4, 6, 7))
    assert jaccard.jaccard_join(empty_docs).count() == 0
    kept = sorted(str(r["doc_id"]) for r in rows(jaccard.keep_first(edge_docs)))
    assert kept == ["1", "3", "4", "5", "6", "7", "None"]


def test_decontamination(spark, edge_docs, empty_docs):
    bench = spark.createDataFrame([(1, "x One two three four five six seven eight nine ten"), (2, "short"), (3, None), (4, "...")], "item_id long, text string")
    got = {r["doc_id"]: r for r in rows(decontam.report(decontam.matches(edge_docs, bench)))}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["longest"]) == (10, 1, 10)
    assert got[1]["items_sha256"] == hashlib.sha256(b"1").hexdigest() and got[7]["n_items"] == 1
    assert [got[k]["n_words"] for k in (3, 4, 6)] == [0, 0, 0] and not got[5]["contaminated"]
    assert sorted(str(r["doc_id"]) for r in rows(decontam.decontaminate(edge_docs, bench))) == ["3", "4", "5", "6", "None"]
    assert decontam.matches(empty_docs, bench).count() == 0
    assert not any(r["contaminated"] for r in rows(decontam.report(decontam.matches(edge_docs, bench.limit(0)))))


def test_suffix_array_orders_all_suffixes():
    code = np.array([1, 2, 1, 2, 1, 0, 2, 1, 0])
    sa = decontam.suffix_array(code, 20)
    cut = lambda p: tuple(code[p : p + list(code[p:]).index(0)])
    assert [cut(p) for p in sa] == sorted(cut(p) for p in range(len(code)))


def test_toxicity_held_out(spark, edge_docs, empty_docs):
    r = random.Random(3)
    made, labels = [], []
    for i in range(900):
        w = [f"w{r.randrange(300)}" for _ in range(60)]
        bad = r.random() < 0.15
        if bad:
            w[r.randrange(60)] = r.choice(["grumble", "snarl"])
        made.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    got = rows(toxicity.score(docs, lab))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([(r["score"] >= 0.3) == bool(truth[r["doc_id"]]) for r in held]) > 0.97
    hit = next(r for r in got if r["spans"])
    s = hit["spans"][0]
    assert dict(made)[hit["doc_id"]][s["start"] : s["end"]] in ("grumble", "snarl")
    assert toxicity.score(edge_docs, lab).count() == 9 and toxicity.score(empty_docs, lab).count() == 0
    assert {r["score"] for r in rows(toxicity.score(edge_docs, lab.limit(0)))} == {0.0}


def whole(texts):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenize.vocabulary_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)


def test_token_files_round_trip(spark, edge_docs, empty_docs):
    manifest = binary.write_ids(edge_docs, tokenize.vocabulary_path())
    got = sorted(rows(binary.read_back(manifest)), key=lambda r: r["start"])
    data = {r["doc_id"]: r["text"] for r in rows(edge_docs)}
    start = 0
    for r in got:
        ids = whole([data[r["doc_id"]]])[0].ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [str(r["doc_id"]) for r in got] == ["None", "1", "2", "2", "3", "4", "5", "6", "7"]
    assert {r["doc_id"]: len(r["ids"]) for r in rows(binary.read_documents(manifest, [4, 7]))} == {4: 1, 7: len(whole(["Short"])[0].ids) + 1}
    assert binary.read_back(binary.write_ids(empty_docs, tokenize.vocabulary_path())).count() == 0


def test_damaged_frame_is_noticed(tmp_path):
    with open(tmp_path / "a", "wb") as f:
        w = binary.Writer(f)
        w.add(1, np.arange(1000, dtype=np.uint32))
        w.close()
    raw = bytearray((tmp_path / "a").read_bytes())
    raw[40] ^= 255
    (tmp_path / "a").write_bytes(raw)
    fs, where = binary.filesystem(str(tmp_path / "a"))
    with fs.open_input_file(where) as source, pytest.raises(Exception):  # noqa: B017
        list(binary.Reader(source).read([1]))


def test_token_counts(spark, edge_docs, empty_docs):
    got = rows(token_counts.section_counts(edge_docs, tokenize.vocabulary_path()))
    data = {r["doc_id"]: r["text"] for r in rows(edge_docs)}
    for i in (1, 3, 4, 5, 6, 7):
        assert sum(r["n_tokens"] for r in got if r["doc_id"] == i) == len(whole([data[i]])[0].ids)
    cut = spark.createDataFrame([(1, "Internationalization of things", [(0, 5), (5, 24)]), (2, None, None)], "doc_id long, text string, sections array<struct<start:int,end:int>>")
    assert [(r["section"], r["n_tokens"], r["n_crossing"]) for r in rows(token_counts.section_counts(cut, tokenize.vocabulary_path(), "sections"))] == [(0, 0, 0), (1, 3, 1)]
    assert token_counts.section_counts(empty_docs, tokenize.vocabulary_path()).count() == 0


def brute_counts(path, text, sections):
    """Tokens and crossing tokens of each section, token by token over the whole text's encoding."""
    from tokenizers import Tokenizer

    out = [[0, 0] for _ in sections]
    for a, b in Tokenizer.from_file(path).encode(text, add_special_tokens=False).offsets:
        shared = [min(b, e) - max(a, s) for s, e in sections]
        if sections and max(shared) > 0:
            k = shared.index(max(shared))  # of equals the first
            out[k][0] += 1
            out[k][1] += a < sections[k][0] or b > sections[k][1]
    return out


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts_brute(spark, name):
    path, r = tokenize.vocabulary_path(name), random.Random(4)
    words = ["Internationalization", "naïve", "東京タワー", "it's", "x", "antidisestablishmentarianism", "12345", "e\u0301t", "🙂🙂"]
    data = []
    for i in range(60):
        text = "".join(r.choice(words) + r.choice([" ", "  ", "\t", "\n", ""]) for _ in range(r.choice([0, 1, 3, 12, 40])))
        cuts = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, r.choice([0, 2, 4, 6, 12]))))
        cuts = cuts[: len(cuts) // 2 * 2]
        data.append((i, text, list(zip(cuts[::2], cuts[1::2], strict=True))))
    docs = spark.createDataFrame(data, "doc_id long, text string, sections array<struct<start:int,end:int>>")
    got = {(x["doc_id"], x["section"]): [x["n_tokens"], x["n_crossing"]] for x in rows(token_counts.section_counts(docs, path, "sections"))}
    assert got == {(i, k): n for i, t, s in data for k, n in enumerate(brute_counts(path, t, s))}


def test_token_count_ties_go_to_the_first_section():
    tokens = np.array([[0, 4], [4, 8], [8, 9], [20, 24]])
    which, crossing = token_counts.allocate(tokens, np.array([0, 2, 7]), np.array([2, 7, 12]))
    assert which.tolist() == [0, 1, 2, -1] and crossing.tolist() == [True, True, False, False]


def test_files_of_a_vocabulary_that_keeps_white_space(spark, edge_docs):
    from tokenizers import Tokenizer

    path = tokenize.vocabulary_path("byte_bpe_50k.json")
    assert tokenize.tokenizer(tokenize.vocabulary_path()).by_parts and not tokenize.tokenizer(path).by_parts
    text = {r["doc_id"]: r["text"] or "" for r in rows(edge_docs)}
    for r in rows(binary.read_back(binary.write_ids(edge_docs, path))):
        ids = np.array([*Tokenizer.from_file(path).encode(text[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))


def test_ann_many_blocks_of_queries(spark, monkeypatch):
    v = np.random.default_rng(3).standard_normal((900, 16)).astype(np.float32)
    data = [(i, x.tolist(), "n") for i, x in enumerate(v)] + [(20, v[21].tolist(), "n"), (None, v[0].tolist(), None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, v string")
    key = lambda r: (r["query_id"], r["rank"], r["vec_id"], r["score"])
    one = sorted(map(key, rows(ann.nearest(df, "vec_id % 20 = 0"))))
    monkeypatch.setattr(ann, "QUERIES", 7)
    assert sorted(map(key, rows(ann.nearest(df, "vec_id % 20 = 0")))) == one and len(one) == 450
    assert ann.nearest(df, "vec_id < 0").count() == 0


def test_mixing(spark, edge_docs, empty_docs):
    docs = spark.createDataFrame([(i, "w " * 10, "big" if i % 10 else "small") for i in range(2000)], "doc_id long, text string, source string")
    got = rows(mixing.mix(docs, repeats=2.0))
    use = {s: sum(r["uses"] for r in got if r["source"] == s) for s in ("big", "small")}
    assert abs(use["small"] - 400) <= 1 and abs(use["big"] - 1600) <= 1
    kept = rows(mixing.mix(docs, repeats=1.5, fill=True))
    assert min(r["uses"] for r in kept) == 1 and abs(sum(r["uses"] for r in kept if r["source"] == "small") - 300) <= 1
    assert mixing.mix(edge_docs, entropy=0.9, repeats=4.0).count() == 9
    assert mixing.mix(empty_docs, entropy=0.9).count() == 0
    out = mixing.apply_mix(edge_docs, repeats=1.25, fill=True)
    assert out.columns == edge_docs.columns and {r["doc_id"] for r in rows(out)} == {r["doc_id"] for r in rows(edge_docs)}
    assert mixing.realise(mixing.mix(docs, repeats=2.0)).count() == sum(use.values())


def test_pii(spark, edge_docs, empty_docs):
    made = [(i, f"call case id {1000000 + i}x or mail agent u{i}@mail.example now") for i in range(30)] + [(99, "see agent 55-KEY-9981 now")]
    seeds = [(100 + i, f"agent +1 (234) 555-{6000 + i} and agent 10.0.0.{i}") for i in range(30)]
    got = {r["doc_id"]: r for r in rows(pii.report(pii.find(spark.createDataFrame(made + seeds, "doc_id long, text string"))))}
    assert got[0]["n_email"] == 1 and got[100]["n_phone"] == 1 and got[100]["n_ip"] == 1
    assert "other:" in got[99]["spans"] and "other:" not in got[0]["spans"]
    found = rows(pii.report(pii.find(edge_docs)))
    assert len(found) == 9 and sum(r["n_email"] for r in found) == 3
    assert pii.find(empty_docs).count() == 0


def test_ann_recall_and_edges(spark):
    r = np.random.default_rng(0)
    v = r.standard_normal((6000, 32)).astype(np.float32)
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(6001, None), (6100, [0.0] * 32), (6200, [float("nan")] * 32), (6300, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = rows(ann.nearest(df, "vec_id % 100 = 0"))
    hit = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((v.astype(float) - v[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        mine = sorted((x["rank"], x["vec_id"], x["score"]) for x in got if x["query_id"] == q)
        assert [x[0] for x in mine] == list(range(1, 11)) and all(abs(d[x[1]] - x[2]) < 1e-12 for x in mine)
        hit += len(set(np.argsort(d)[:10]) & {x[1] for x in mine})
    assert hit / 600 >= 0.9 and {x["query_id"] for x in got} == set(range(0, 6000, 100))
    assert ann.nearest(df.limit(0), "vec_id % 100 = 0").count() == 0


def test_urls(spark):
    data = [(1, "http://A.Example.NET/en/1?x"), (2, "http://x.net"), (3, None), (4, "no scheme"), (5, "https://example.com/de/#f"), (6, "ftp://b.org/fr/2"), (7, "http://other.com/x"), (8, "http://net/"), (9, "")]
    got = {r["page_id"]: r for r in rows(urls.judge(spark.createDataFrame(data, "page_id long, url string")))}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2]["rule"] is None and got[8]["rule"] == "net/" and got[5]["verdict"] == "block" and got[6]["rule"] == "org/fr/"
    assert all((got[i]["host"], got[i]["path"], got[i]["rule"]) == ("", "", None) for i in (3, 4, 9))
    many = [(i, f"http://{'good' if i % 2 else 'spam'}{i}.{'org/fr' if i % 2 else 'net/xx'}/{'poem' if i % 2 else 'casino'}/{i}") for i in range(2000)]
    more = [(5000, "http://a.com/poem/7"), (5001, "http://a.com/casino/7")]
    got = {r["page_id"]: r for r in rows(urls.judge(spark.createDataFrame(many + more, "page_id long, url string")))}
    assert (got[5000]["verdict"], got[5001]["verdict"]) == ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_lines(spark, edge_docs, empty_docs):
    r = random.Random(5)
    words = [f"token{i}" for i in range(500)]
    base = [" ".join(r.choice(words) for _ in range(30)) for _ in range(60)]
    near = [t.replace("token1", "tokenX", 1) if "token1" in t else t + " end" for t in base[:20]]
    docs = [(i, t + "\n\n" + near[i % 20] + "\nonly here " + hashlib.md5(str(i).encode()).hexdigest()) for i, t in enumerate(base)]
    got = {r["doc_id"]: r["removed"] for r in rows(lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")))}
    assert all(got[i] == [2] for i in range(60))
    out = rows(lines.dedup(edge_docs))
    assert len(out) == 9 and next(r for r in out if r["doc_id"] == 2)["removed"] == [0] and next(r for r in out if r["doc_id"] == 6)["removed"] == []
    assert lines.dedup(empty_docs).count() == 0
    text = {r["doc_id"]: r["text"] for r in rows(lines.rewrite(edge_docs))}
    assert text[1] and text[2] == "" and text[3] is None


def test_words_match_the_pattern(edge_docs):
    for r in rows(edge_docs):
        assert len(split_words(r["text"])) == len((r["text"] or "").encode().split())
