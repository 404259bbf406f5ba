"""Token counts, decontamination, quality, near duplicates and page extraction against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logweave.llm import components, decontaminate, html, quality, simhash, tokens
from logweave.llm.queries import quality_vocabularies, vocabulary

ODD = [None, "", " \t\n", "one", "one two", "Straße ﬁ é 漢字 🙂 <|endoftext|> don't", "a" * 3000, "word " * 4000, "x\x00y\x1cz", "same same", "same same"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None if k == 3 else k, t) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string")).withColumn("fp", F.lit("clash")).withColumn("items", F.lit("clash"))


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_tokens_equal_the_library(spark, sf, odd):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        given = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        want = Counter((i, len(t.encode()), len(e.ids), len(e.ids) > 2048) for (i, t), e in zip(given, library.encode_batch([t for _, t in given], add_special_tokens=False), strict=True))
        assert Counter(map(tuple, tokens.count_tokens(df, path).collect())) == want
    assert tokens.count_tokens(odd.limit(0), path).count() == 0


def test_tokens_of_noise_equal_the_library():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    counter, library, rng = tokens.TokenCounter(path), Tokenizer.from_file(path), random.Random(5)
    alphabet = "aaabcde 'stST’ΣσİßéÉ́漢ﬁ²½ \x1c\x85\xa0 \n<|endoftext|>09_-…!!🙂"
    noise = ["".join(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(800)] + ["aaaa" * 300, "ababab" * 200] + ["".join(rng.choices("abcdest", k=5000)), "a" * 4097, "abc" * 3000, "é" * 2500]
    assert counter.count(noise) == [len(e.ids) for e in library.encode_batch(noise, add_special_tokens=False)]


def test_one_word_of_a_megabyte():
    import time

    counter, rng = tokens.TokenCounter(vocabulary("word_bpe_49k.json")), random.Random(6)
    for word in ("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)), "a" * 1_000_000, "=" * 1_000_000):
        began = time.time()
        assert counter.count([word])[0] > 1000
        assert time.time() - began < 30


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(10, len(w))
        for k in range(max(1, len(w) - 9) if w else 0):
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[k : k + n]:
                    hit.update(range(at, at + n))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary_ = [f"w{k}" for k in range(30)] + ["Ünï", "é", "the", "THE"]
    items = [(k, " ".join(rng.choices(vocabulary_, k=n))) for k, n in enumerate([12, 30, 10, 9, 3, 2, 1, 0, 11, 40])] + [(20, None), (21, "dup one two three four five six seven eight nine ten"), (21, "another row of the same item id with more words in it")]
    rows = [(1, None), (2, "")]
    for i in range(3, 60):
        words = rng.choices(vocabulary_, k=rng.randint(0, 120))
        if i % 3 == 0:
            source = items[rng.randrange(len(items))][1] or ""
            at = rng.randint(0, len(words))
            words[at:at] = source.split()
        rows.append((i, rng.choice([" ", ", ", "\n-"]).join(words)))
    rows += [rows[5], (60, "x" * 300_000 + " " + items[1][1]), (None, items[1][1].upper())]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_hit", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((i, *brute_hits(t, items)) for i, t in rows)
    for block in (decontaminate.BLOCK_BYTES, 200):
        got = decontaminate.find_items(given, bench, block_bytes=block).drop("items")
        assert Counter(map(tuple, got.collect())) == want
    assert decontaminate.find_items(given.limit(0), bench).count() == 0
    assert decontaminate.find_items(given, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    kept = decontaminate.drop_contaminated(given, bench)
    clean = Counter((i, t) for i, t in rows if not brute_hits(t, items)[1])
    assert kept.columns == given.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == clean
    assert Counter((r["doc_id"], r["text"]) for r in decontaminate.drop_contaminated(given, bench, block_bytes=200).collect()) == clean


def test_large_benchmarks_take_two_passes(spark):
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x i{k}w3 " + " ".join(f"i{k}w{j}" for j in range(5, 16))) for k in range(40)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.find_items(docs, items, block_bytes=1000, log_bits=20).collect()}
    assert got == {k: (11, [str(k)]) for k in range(40)}


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality_equals_brute_force(spark, sf, odd):
    path = quality_vocabularies()
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        got = quality.score_quality(df, path).collect()
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == Counter((r["doc_id"], *brute_quality(r["text"])) for r in df.collect())
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.score_quality(odd.limit(0), path).count() == 0
    kept = quality.keep_good(spark.read.parquet(f"{sf}/documents.parquet"), path)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_fertility_equals_direct_counts(texts):
    import sentencepiece

    path = quality_vocabularies()
    sp, model = sentencepiece.SentencePieceProcessor(model_file=path[0]), quality.Fertility(*path)
    for t in list(texts.values())[:40]:
        ids = [i for w in t.encode().split() for i in sp.encode(w.decode())]
        m = model.measure(Counter(t.encode().split()), len("".join(t.split())))
        n, share, entropy = m.tokens, m.fallback, m.entropy
        assert m.other == pytest.approx(m.chars * n / sum(len(model.other.encode_ordinary(w.decode())) for w in t.encode().split()) if n else 0)
        counts = Counter(ids)
        assert n == len(ids) and share == pytest.approx(sum(sp.is_byte(i) for i in ids) / max(1, len(ids)))
        assert entropy == pytest.approx(-sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values()), abs=1e-9)


def test_quality_keeps_good_documents(spark):
    """On documents that the bands were not fitted on: odd ids, and of short ones the same."""
    d = "/root/testdata/sf0.1"
    scored = quality.score_quality(spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 2 = 1"), quality_vocabularies())
    held = scored.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").select("quality", "kept", "n_words").collect()
    share = lambda q, test=lambda r: True: sum(r["kept"] for r in held if r["quality"] == q and test(r)) / max(1, sum(r["quality"] == q and test(r) for r in held))
    assert share(1) > 0.995 and share(1, lambda r: r["n_words"] < 80) > 0.95 and share(0) < 0.05


def test_bands_are_what_the_fit_gives(spark):
    d = "/root/testdata/sf0.1"
    scored = quality.score_quality(spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 2 = 0"), quality_vocabularies())
    good = scored.join(spark.read.parquet(f"{d}/labels.parquet").where("quality = 1"), "doc_id").where("not base_failed").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = good.orderBy("doc_id").collect()
    for lang, band in quality.LANGUAGES.items():
        made = quality.fit_language([quality.Measures(r["n_tokens"], r["chars_per_token"], r["fallback_share"], r["other_chars_per_token"], r["token_entropy"]) for r in rows if r["lang"] == lang])
        assert made == band


def test_scripts():
    assert quality.script_of("hello wörld") == "latin" and quality.script_of("привет мир") == "cyrillic" and quality.script_of("漢字かな") == "cjk" and quality.script_of("123 ...") == "other"


def brute_print(t):
    words = (t or "").encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        out |= (2 * sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) > len(shingles)) << bit
    return out


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprints(odd):
    for r in odd.collect():
        assert simhash.fingerprint((r["text"] or "").encode()) == brute_print(r["text"])


def test_near_duplicates_equal_brute_force(spark, sf, odd):
    for df in (odd, spark.read.parquet(f"{sf}/documents.parquet")):
        rows = df.select("doc_id", "text").collect()
        prints = [brute_print(r["text"]) for r in rows]
        roots = brute_components(prints)
        least = {}
        for r, k in zip(rows, roots, strict=True):
            if r["doc_id"] is not None:
                least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
        want = Counter((r["doc_id"], f"{p:016x}", least.get(k)) for r, p, k in zip(rows, prints, roots, strict=True))
        assert Counter(map(tuple, simhash.near_duplicates(df).collect())) == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links_connect_all_near_fingerprints(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in list(prints):  # chains and clouds at distances 1 to 5
        for _ in range(5):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 5)):
                q ^= 1 << b
            prints.append(q)
            p = q if rng.random() < 0.5 else p
    prints = sorted(set(prints))
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    root = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    want = brute_components(prints)
    got = [root.get(s, s) for s in signed]
    assert len(set(zip(want, got, strict=True))) == len(set(want)) == len(set(got))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, k) for k in range(501, 560)] + [(900, 900)]
    out = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[k] for k in range(101)} == {0} and {out[k] for k in range(500, 560)} == {500} and 900 not in out
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    groups = {r["component_id"] for r in simhash.near_duplicates(df).collect()}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == groups


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><header>Top</header><article class="post"><header><h1>Title</h1><p>by me</p></header><p>One &lt;b&gt; <i>t</i>wo&nbsp; three<br>four<p>Five<div class="ad">buy</div><aside>w</aside><form>f</form>six</article><section id="comments"><article class="comment"><p>no</p></article></section><footer>&copy; x</footer><script>var a="</p>";</script></body></html>'


def test_marked_articles(spark):
    rows = [(1, "http://a.com/x", PAGE), (2, None, None), (3, "http://a.com/y", ""), (4, "no url", "<p>plain"), (4, "no url", "<p>plain"), (None, "http://b.com", "<main><p>m</p></main><p>o</p>"), (6, "http://c.com", "<article>" + "<p>long text</p>" * 5000 + "</article>")]
    given = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))
    out = [r.asDict() for r in html.extract_main_text(given).collect()]
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    by = {r["page_id"]: r["text"] for r in out}
    assert by[1] == "Title\n\nOne <b> two three four\n\nFive\n\nsix" and by[2] == by[3] == "" and by[None] == "m"
    assert by[4] == "plain" and by[6] == "\n\n".join(["long text"] * 5000)
    assert html.extract_main_text(given.limit(0)).count() == 0


def test_elements_that_are_not_closed():
    read = lambda h: html.read_blocks(h)
    assert read('<article><p class="notice">x<p>a<p>b</article>')[0] == ["a", "b"]
    assert read('<article><p>a <span class="share">x</p><p>b</p></article>')[0] == ["a", "b"]
    assert read('<nav><ul><li>x<article><p>a</p></article>')[0] == ["a"]
    assert read("<head><title>t</title><body><p>a")[2] == ["a"]
    assert read('<div class="ad">x<div>y</div></div>a')[2] == ["a"]


def test_wrappers_with_cues(spark):
    given = spark.createDataFrame([(1, "http://a.com", '<div class="has-sidebar"><p>a</p><nav>n</nav><p>b</p></div>')], "page_id long, url string, html string")
    assert html.extract_main_text(given).first()["text"] == "a\n\nb"


def test_cues_are_whole_names(spark):
    read = lambda h: html.read_blocks(h)
    assert read('<article><section id="related-work"><h2 id="social-media">A</h2><p>b</p></section><section id="search"><h2 id="search">C</h2></section><div class="search-results">d</div></article>')[0] == ["A", "b", "C", "d"]
    assert read('<article><p>a</p><div class="x related-posts">b</div><div id="shareButtons">c</div><section class="related">d</section></article>')[0] == ["a"]
    long = "<p>all the text of the page</p>" * 3
    assert html.page_blocks(f'<article><p>short</p><div class="ad">{long}</div></article>') == [("article", "short")]
    given = [(1, "http://a.com", f'<div class="sidebar">{long}</div><p>note</p>'), (2, "http://b.com", f'<p>short</p><div class="comments">{long}</div>')]
    out = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(given, "page_id long, url string, html string")).collect()}
    assert out[1].count("all the text") == 3 and out[1].endswith("note") and out[2] == "short"


def test_teasers_do_not_hide_the_body(spark):
    body = {k: " ".join(f"word{k}x{j}" for j in range(40)) for k in range(6)}
    foot = "<div>Contact us at this place or by phone any time of day</div>"
    page = lambda k, wrap: f"<{wrap}><p>{body[k]}</p></{wrap}><article><p>teaser {k}</p></article>{foot}"
    rows = [(k, f"https://h.org/{k}", page(k, "main" if k % 2 else "div")) for k in body]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {k: f"{t}\n\nteaser {k}" for k, t in body.items()}


def test_suffix_array_removes_what_pages_of_a_host_share(spark):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40))
    own = {k: prose() for k in range(30)}
    rows = [(k, f"https://h.org/{k}", f"<div>Menu One Two Three Four Five Six Seven Eight</div><div>{t}</div><div>Contact us at this place or by phone any time of day</div>") for k, t in own.items()]
    given = spark.createDataFrame(rows + [(r[0] + 100, *r[1:]) for r in rows[:2]], "page_id long, url string, html string")
    for most in (html.SHARED_BYTES, 0):
        got = html.extract_main_text(given, shared_bytes=most, log_bits=16)
        assert {r["page_id"] % 100: r["text"] for r in got.collect()} == own


def test_covered_runs_are_cut_out_of_blocks(spark):
    menu = "Menu One Two Three Four Five Six Seven Eight"
    own = {k: " ".join(f"w{k}x{j}" for j in range(4 if k % 2 else 40)) for k in range(60)}
    rows = [(k, f"https://h.org/{k}", f"<div>{menu} {t}</div>" if k < 10 else f"<div>{t}</div>") for k, t in own.items()]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == own


def test_articles_lose_what_most_pages_of_a_host_have(spark):
    share = "<p>Please share this post with all of your friends today</p>"
    quote = "this passage is quoted by some pages of the host only"
    own = {k: " ".join(f"w{k}x{j}" for j in range(20)) + (f" {quote}" if k < 4 else "") for k in range(12)}
    rows = [(k, f"https://h.org/{k}", f"<article><p>{t}</p>{share}</article>") for k, t in own.items()]
    rows += [(100 + k, f"https://few.org/{k}", f"<article><p>same copied text on every page of a small host</p><p>{k}</p></article>") for k in range(3)]
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: got[k] for k in own} == own and all(got[100 + k].startswith("same copied") for k in range(3))


def brute_text(pages):
    """Texts by the definition: pages are (host, url's page blocks); every stretch is compared with every page's."""
    read = []
    for host, source in pages:
        placed = html.page_blocks(source)
        if not any(w == "article" for w, _ in placed) and any(w == "main" for w, _ in placed):
            placed = [("article", t) for w, t in placed if w == "main"]
        read.append((host, [(w == "article", t.split(" ")) for w, t in placed]))
    stream = lambda blocks, sure: [x for s, b in blocks if s == sure for x in [*b, None]]
    grams = lambda x: [tuple(x[i : i + html.RUN]) for i in range(len(x) - html.RUN + 1)]
    out = []
    for host, blocks in read:
        flags = {}
        for sure in (False, True):
            others = {tuple(stream(b, sure)) for h, b in read if h == host} - {()}
            need = (len(others) // 2 + 1 if len(others) >= 4 else 10**9) if sure else (min(3, len(others)) if len(others) > 1 else 10**9)
            mine, held = stream(blocks, sure), [set(grams(o)) for o in others]
            flags[sure] = [False] * len(mine)
            for i, g in enumerate(grams(mine)):
                if sum(g in h for h in held) >= need:
                    flags[sure][i : i + html.RUN] = [True] * html.RUN
        at, kept = {False: 0, True: 0}, []
        for sure, b in blocks:
            kept.append(" ".join(w for k, w in enumerate(b) if not flags[sure][at[sure] + k]))
            at[sure] += len(b) + 1
        out.append("\n\n".join(k for k in kept if k))
    return out


@pytest.mark.parametrize("most", [html.SHARED_BYTES, 0])
def test_main_text_equals_brute_force(spark, most):
    rng = random.Random(4)
    phrases = [" ".join(rng.choices(["ab", "cd", "é", "x&amp;y"], k=rng.randint(4, 14))) for _ in range(6)]
    piece = lambda: rng.choice(phrases) if rng.random() < 0.6 else " ".join(rng.choices("pqrstuv", k=rng.randint(1, 12)))
    pages = []
    for _ in range(60):
        blocks = "".join(f"<p>{piece()} {piece()}</p>" for _ in range(rng.randint(0, 3)))
        article = "<article>" + "".join(f"<p>{piece()}</p>" for _ in range(rng.randint(1, 3))) + "</article>" if rng.random() < 0.5 else ""
        pages.append((rng.choice(["a.org", "b.org", "c.org", ""]), blocks + article))
    pages += pages[:5]
    given = spark.createDataFrame([(k, f"http://{h}/{k}" if h else None, s) for k, (h, s) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(given, shared_bytes=most, log_bits=12).collect()}
    want = brute_text(pages)
    assert got == dict(enumerate(want)) and any(len(w) < len(t) for w, t in zip(want, brute_text([(str(k), s) for k, (_, s) in enumerate(pages)]), strict=True))


def test_odd_markup_is_read_in_linear_time():
    import time

    assert html.read_blocks("<article><p title=it's>hey</p><p>don't</p></article>")[0] == ["hey", "don't"]
    assert html.read_blocks("<p>1 < 2 <3 a<b>c</b></p><!-->x<!-- y -- z --><p a=\"1>2\" b='<p>' c>d</p></ >e<?php f?>")[2] == ["1 < 2 <3 ac", "x", "d", "e"]
    assert html.read_blocks("<article><header><h1>T</h1><p>by me</p><p>a lead of more than eight words that must not get lost</p></header><fieldset>f</fieldset><math>m</math></article>")[0] == ["T", "a lead of more than eight words that must not get lost", "f", "m"]
    for unit in ("<a ", "<a b='", '<a b="', "<!--", "</", "<", "<p", "&", "<a b= ", "<article>", "<svg>", "<script>", "'", "<a b=c ", "<select "):
        began = time.time()
        html.page_blocks(unit * (1_000_000 // len(unit)))
        assert time.time() - began < 10, unit
