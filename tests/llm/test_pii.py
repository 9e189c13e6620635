import numpy as np
import pytest

from loomtext.llm import pii, queries

GIVEN = frozenset(map(pii.norm_word, ["Grace", "Mark", "Hope", "Clement", "سحر", "بهار", "نادر"]))
COMMON = frozenset("we met near the archive call is as wrote in margin and hope will not mark a rose to from with press street between در خیابان بود و داستان قرأ النص با شماره است can be reached at lives".split())


@pytest.fixture(scope="module")
def proposer():
    return pii.Proposer(pii.Lexicon(GIVEN, COMMON))


def spans(proposer, text, kind):
    return [text[m.start : m.end] for m in proposer(text) if kind in m.kinds]


@pytest.mark.parametrize(
    "text,found",
    [
        ("write to ros_holm@tarjoman.example.org now", ["ros_holm@tarjoman.example.org"]), ("mailto:maud-aske@kelid.example!", ["maud-aske@kelid.example"]), ("x holm86 [at] harlow-press [dot] example [dot] net y", ["holm86 [at] harlow-press [dot] example [dot] net"]),
        ("a leo (at) kelid.example b", ["leo (at) kelid.example"]), ("rafidi23＠kelid.example", ["rafidi23＠kelid.example"]), ("Write user@ and a space, as in ticket #7.", []), ("186 tokens @ 17 per second.", []), ("https://docs.x.example/a?b=1", []),
    ],
)
def test_emails(proposer, text, found):
    assert spans(proposer, text, pii.EMAIL) == found


@pytest.mark.parametrize(
    "text,found",
    [
        ("Call +44 20 7946 0328 (evenings).", ["+44 20 7946 0328"]), ("try (217) 555-0182.", ["(217) 555-0182"]), ("تلفن ۰۲۱-۵۵۵۰۰۱۸۸ است", ["۰۲۱-۵۵۵۰۰۱۸۸"]), ("on 28/05/1996 at 10:30", []), ("at ٠٠٩٧١ ٤\n٥٥٥ ٠١٦٩.", ["٠٠٩٧١ ٤\n٥٥٥ ٠١٦٩"]),
        ("Mobile: 790-555-0155\n2. Next", ["790-555-0155"]), ("costs 45,525.00", []),
    ],
)
def test_numbers(proposer, text, found):
    assert spans(proposer, text, pii.PHONE) == found


def test_codes(proposer):
    assert spans(proposer, "passport ZZ 109 9336. card QQ 48 72 83 C. passport no. X08237351,", pii.IDENTITY) == ["ZZ 109 9336", "QQ 48 72 83 C", "X08237351"]


@pytest.mark.parametrize(
    "text,found",
    [
        ("to Flat 18, 77 Wren St., Northbrook Ferry, not", ["Flat 18, 77 Wren St., Northbrook Ferry"]), ("at 34B Alder Street", ["34B Alder Street"]), ("The street was empty, and house 12 has no door.", []), ("نشانی خیابان چنار، پلاک 162، واحد 1 تحویل", ["خیابان چنار، پلاک 162، واحد 1"]),
        ("همان آبشارآباد، خیابان سپیدار، کوچه آفتاب، پلاک ۱۱۷ است", ["آبشارآباد، خیابان سپیدار، کوچه آفتاب، پلاک ۱۱۷"]), ("إلى وادي الزمرد، شارع الزيتون، رقم ١٢.", ["وادي الزمرد، شارع الزيتون، رقم ١٢"]), ("في 8 شارع الياسمين، عين الصفا،", ["8 شارع الياسمين، عين الصفا"]), ("حي الزيتون، مبنى 225، شقة 1، رقم الهوية ٣", ["حي الزيتون، مبنى 225، شقة 1"]),
    ],
)
def test_addresses(proposer, text, found):
    assert spans(proposer, text, pii.ADDRESS) == found


@pytest.mark.parametrize(
    "text,found",
    [
        ("We met Grace Luskwick near", ["Grace Luskwick"]), ("As Prof. G. Keldburne wrote", ["G. Keldburne"]), ("cc: Varnleigh, Mark; CLEMENT DUNOVIC.", ["Varnleigh, Mark", "CLEMENT DUNOVIC"]), ("Mark D. Hollo-Ashby's idea", ["Mark D. Hollo-Ashby"]), ("Grace and hope will not mark a rose.", []),
        ("خانم سحر شاهگپور با شماره", ["سحر شاهگپور"]), ("خیابان بود و بهار در داستان", []), ("قرأ الدكتور نادر البرقاتي النص", ["نادر البرقاتي"]),
    ],
)
def test_names(proposer, text, found):
    assert spans(proposer, text, pii.NAME) == found


NO_SKIP = np.zeros((len(pii.REPEATS), len(pii.KINDS), len(pii.KINDS)))
AGREE = NO_SKIP + 1.5 * np.eye(len(pii.KINDS))


def mention(a, z, kinds, features, keys=()):
    return pii.Mention(a, z, kinds, features, keys)


def brute_marginals(model, mentions, edges):
    local = model.local(mentions)
    total = np.zeros_like(local)
    for labels in np.ndindex(*[len(pii.KINDS)] * len(mentions)):
        w = np.exp(sum(local[i, y] for i, y in enumerate(labels)) + sum(p[labels[i], labels[j]] for i, j, p in edges))
        for i, y in enumerate(labels):
            total[i, y] += w
    return total.argmax(1).tolist()


def test_belief_propagation_is_exact_on_chains():
    rng = np.random.default_rng(3)
    for _ in range(20):
        model = pii.SkipChainModel(rng.normal(size=(pii.BUCKETS, len(pii.KINDS))), rng.normal(size=(len(pii.KINDS),) * 2), NO_SKIP)
        ms = [mention(10 * i, 10 * i + 5, (pii.PHONE, pii.NAME), [f"f{rng.integers(9)}"]) for i in range(4)]
        assert model.label(ms) == brute_marginals(model, ms, [(i, i + 1, model.chain) for i in range(3)])


def test_repeated_mentions_agree():
    w = np.zeros((pii.BUCKETS, len(pii.KINDS)))
    w[pii.bucket("clear"), pii.NAME] = 3.0
    w[pii.bucket("vague"), pii.NONE] = 0.4
    model = pii.SkipChainModel(w, np.zeros((len(pii.KINDS),) * 2), AGREE)
    alone = [mention(0, 5, (pii.NAME,), ["clear"]), mention(900, 905, (pii.NAME,), ["vague"])]
    assert model.label(alone) == [pii.NAME, pii.NONE]
    for m in alone:
        m.keys = ("fsame",)
    assert model.label(alone) == [pii.NAME, pii.NAME] and model.label(alone, skips=False) == [pii.NAME, pii.NONE]


def test_belief_propagation_with_a_skip_edge_on_a_tree():
    rng = np.random.default_rng(5)
    for _ in range(20):
        skip = rng.normal(size=(len(pii.REPEATS), len(pii.KINDS), len(pii.KINDS)))
        model = pii.SkipChainModel(rng.normal(size=(pii.BUCKETS, len(pii.KINDS))), rng.normal(size=(len(pii.KINDS),) * 2), skip)
        ms = [mention(0, 5, (pii.PHONE, pii.NAME), ["f1"], ("fx",)), mention(10, 15, (pii.PHONE, pii.NAME), ["f2"]), mention(900, 905, (pii.PHONE, pii.NAME), ["f3"], ("fx",))]
        assert pii.skip_edges(ms) == [(0, 2, pii.REPEATS.index("f"))] and pii.chain_edges(ms) == [(0, 1)]
        assert model.label(ms) == brute_marginals(model, ms, [(0, 1, model.chain), (0, 2, skip[pii.REPEATS.index("f")])])


def test_pseudo_likelihood_learns_repetition():
    """Where features say nothing, the label of the repeated mention is learned to decide, for and against agreement."""
    f = np.array([1])
    admitted = np.array([0, -1e9, -1e9, -1e9, -1e9, 0])
    for agree in (True, False):
        examples = [pii.Example(f, admitted, y if agree else pii.NAME - y, 1.0, (), (), ((pii.REPEATS.index("f"), y),)) for y in (pii.NONE, pii.NAME)] * 50
        skip = pii.pseudo_likelihood(examples, 4, 0.3, 1e-4).skip[pii.REPEATS.index("f")]
        assert (skip[pii.NAME, pii.NAME] + skip[pii.NONE, pii.NONE] > skip[pii.NAME, pii.NONE] + skip[pii.NONE, pii.NAME] + 1) == agree


def test_fitted_skip_edges_change_rows(spark, sf):
    """A person named with a title is found elsewhere in the text too, in a place that says nothing; not so without the skip edges."""
    sf = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    given = pii.given_name_list(spark.read.parquet(f"{sf}/given_names.parquet"), "given_name")
    lexicon, model = pii.fit(docs, "text", given)
    propose, changed = pii.Proposer(lexicon), []
    for later in ("Later Ilmari Quantock shared a desk.", "Version 4 of the Ilmari Quantock Glossary is out.", "The riddle asks which of Ilmari Quantock and others won."):
        ms = propose(f"We met Dr. Ilmari Quantock near the archive. {later}")
        assert [(x, y) for x, y in zip(model.label(ms), model.label(ms, skips=False))][0] == (pii.NAME, pii.NAME)
        changed += [(x, y) for x, y in zip(model.label(ms), model.label(ms, skips=False)) if x != y]
    assert changed and set(changed) == {(pii.NAME, pii.NONE)}


def test_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    given = pii.given_name_list(spark.read.parquet(f"{sf}/given_names.parquet"), "given_name")
    lexicon, model = pii.fit(docs, "text", given)
    rows = [(1, "Call +44 20 7946 0328 (evenings only). We met Grace Luskwick near the archive."), (2, None), (3, ""), (4, "Mail: leo@kelid.example"), (4, "Mail: leo@kelid.example"), (None, "Mobile: 790-555-0155"), (5, "The archive opened. " * 2000 + "Mobile: 790-555-0155")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "'x' as kind", "0 as start_pos")
    got = {(r["doc_id"], r["kind"], r["start_pos"]) for r in pii.find_personal(df, "doc_id", "text", lexicon, model).collect()}
    assert got == {(1, "phone", 5), (1, "name", 46), (4, "email", 6), (None, "phone", 8), (5, "phone", 40008)}
    texts = {r["doc_id"]: r["text"] for r in pii.redact(df, "doc_id", "text", lexicon, model).collect()}
    assert texts[1] == "Call [PHONE] (evenings only). We met [NAME] near the archive." and texts[2] is None and texts[3] == "" and texts[4] == "Mail: [EMAIL]"
    assert pii.find_personal(df.where("false"), "doc_id", "text", lexicon, model).count() == 0


def test_words_that_follow_a_listed_name_as_a_rule_are_no_family_names(spark):
    """"Last spring", where the spring is a listed name too, is no person, however often it is written."""
    plain = ["نسخه را طبق توافق بهار گذشته بررسی کرد. هر بهار باران بارید.", "خانم بهار شاهگپور خواند.", "آقای نادر شاهگپور خواند.", "نادر دریاپور و سحر دریاپور خواندند."]
    df = spark.createDataFrame([(i, plain[i % 4]) for i in range(80)], "doc_id long, text string")
    lexicon, model = pii.fit(df, "text", GIVEN)
    assert {"شاهگپور", "دریاپور"} <= lexicon.family and "گذشته" not in lexicon.family
    found = {plain[r["doc_id"] % 4][r["start_pos"] : r["end_pos"]] for r in pii.find_personal(df, "doc_id", "text", lexicon, model).collect()}
    assert found == {"بهار شاهگپور", "نادر شاهگپور", "نادر دریاپور", "سحر دریاپور"}


def test_places_taken():
    spans = pii.Spans([mention(10, 20, (), []), mention(2, 5, (), []), mention(30, 31, (), [])])
    taken = [(2, 5), (10, 20), (30, 31)]
    for a in range(35):
        for z in range(a + 1, 36):
            assert spans.hit(a, z) == any(a < y and x < z for x, y in taken)


def test_sentence_starts():
    for text, start in (("Word", True), ("« Word", True), ("It ended. Word", True), ("It ended.” — Word", True), ("by G. Word", False), ("with Prof. Word", False), ("see\n\n*   Word", True), ("list:\n- Word", True), ("a, Word", False), ("said “Word", True), ("page 5. Word", True)):
        assert pii._begins_sentence(text, text.index("Word")) == start, text


def test_common_words_are_not_cut(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = " ".join(f"{a}{b}{c}{d}" for a in letters[:3] for b in letters for c in letters for d in letters)
    rows = [(1, f"{many} {many}"), (2, "They met Grace Luskwick and later Grace Tamberly near the archive."), (3, "the luskwick is a bird")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon, model = pii.fit(df, "text", frozenset(("grace",)))
    assert {(r["doc_id"], r["kind"], r["start_pos"]) for r in pii.find_personal(df, "doc_id", "text", lexicon, model).collect()} == {(2, "name", 34)}
    assert {r["doc_id"]: r["text"] for r in pii.redact(df, "doc_id", "text", lexicon, model).collect()}[2] == "They met Grace Luskwick and later [NAME] near the archive."


def test_looked_up_common_words(spark, sf, monkeypatch):
    """A list too long to be sent along gives the same mentions and the same model."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    given = pii.given_name_list(spark.read.parquet(f"{sf}/given_names.parquet"), "given_name")
    got = []
    for bound in (50_000, 10):
        monkeypatch.setattr(pii, "COMMON_WORDS", bound)
        lexicon, model = pii.fit(docs, "text", given)
        assert (lexicon.table is None) == (bound > 10)
        got.append((model.weights.tobytes(), sorted(pii.find_personal(docs, "doc_id", "text", lexicon, model).collect()), sorted(pii.redact(docs, "doc_id", "text", lexicon, model).dropna().collect())))
    assert got[0] == got[1]

    class Asked(frozenset):
        def __contains__(self, w):
            asked.add(w)
            return super().__contains__(w)

    propose = pii.Proposer(pii.Lexicon(given, Asked(), Asked()))
    for t in [r["text"] for r in docs.collect() if r["text"]] + ["Smith، شارع النصر 5، دبي", "كتبنا إلى دبي الجديدة، شارع النصر"]:
        asked = set()
        propose(t)
        assert asked <= set(pii.asked_words(t))


def test_fit_on_empty_table(spark):
    lexicon, model = pii.fit(spark.createDataFrame([], "text string"), "text", frozenset())
    assert model.label([]) == [] and not lexicon.common


def test_query(spark, sf):
    df = queries.p9_found(spark, sf)
    assert df.dtypes == [("doc_id", "bigint"), ("kind", "string"), ("start_pos", "int")]
    assert {r["kind"] for r in df.collect()} <= set(pii.KINDS)
