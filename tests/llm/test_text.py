"""The text operators on small tables: what they find, and nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from postmere.llm import encoding, leakage, mixing, pii, quoting, spam

REC = "delivery_id bigint, kind string, source string, source_uid string, thread_id string, subject string, content string, from_addr string, delivered_at timestamp, tokens string, text string, `group` string, line_no string"


def records(spark, rows):
    full = [(r.get("id"), r.get("kind", "email"), r.get("source", "gmail:p"), r.get("uid", f"u{k}"), r.get("thread"), r.get("subject"), r.get("content"), r.get("from"), None, "clash", "clash", "clash", "clash") for k, r in enumerate(rows)]
    return spark.createDataFrame(full, REC)


# Wrong decoding

WORDS = ["für", "nächste", "Rückfrage", "Küche", "Påminnelse", "lørdag", "strømregningen", "réunion", "année", "mañana", "niño", "Änderung", "Schlüssel", "får", "søknaden", "theatre", "clé", "relevé"]


def sentences_of(n=300):
    rng = random.Random(5)
    return [" ".join(rng.choices(WORDS, k=6)) for _ in range(n)]


def test_wrong_decoding_is_found_and_undone(spark):
    good = sentences_of()
    bad = {1000: ("utf8", "cp1252"), 1001: ("utf8", "mac_roman"), 1002: ("cp1252", "mac_roman"), 1003: ("cp850", "cp1252"), 1004: ("utf8", "cp1251")}
    text = "Rückfrage für nächste Küche lørdag mañana"
    rows = [{"id": k, "subject": t, "content": t} for k, t in enumerate(good)]
    garbled = {i: text.encode(e).decode(d, "replace") for i, (e, d) in bad.items()}
    rows += [{"id": i, "content": g} for i, g in garbled.items()]
    rows += [{"id": 2000, "content": "SÃO PAULO, AMANHÃ"}, {"id": 2001, "content": "A&ring;pent =?utf-8?Q?Sp=C3=B8rsm=C3=A5l?="}, {"id": 2002}, {"id": 2003, "content": "", "source": None}, {"id": 2004, "content": "f�r"}, {"id": None, "content": garbled[1000]}, {"id": 1000, "content": garbled[1000]}]
    found = encoding.find_garbled(records(spark, rows)).collect()
    assert sorted({(r["delivery_id"], r["field"]) for r in found}) == [(i, "content") for i in (*bad, 2004)]
    fixes = {r["delivery_id"]: r["fixes"] for r in found}
    one = spark.createDataFrame([(garbled[1000], fixes[1000])], "t string, f map<string,string>").select(encoding.repaired(F.col("t"), F.col("f")).alias("t")).first()["t"]
    assert one == text
    assert encoding.find_garbled(records(spark, rows).limit(0)).collect() == []


def test_chains_round_trip():
    for chain in encoding.CHAINS[1:]:
        text = "Größe før clé" if all(e != "cp1251" and e != "koi8_r" for _, e in chain) else "Вопрос за отчёт"
        try:
            seen = text
            for wrong, true in reversed(chain):
                seen = seen.encode(true).decode(wrong)
        except (UnicodeDecodeError, UnicodeEncodeError):
            continue
        assert encoding.undo(seen, chain) == text or not encoding.undo(seen, chain)


# Quoted history

MAIL = """Hello Cai,
We settle the fence on Monday. The boat leaves at noon.
> 3 weeks is simply too long for us
It stays as it is.

Kind regards
Noor Adebarin

--
Noor Adebarin
Head of Operations | Moorgate Parking
Tel. 07700 900744

Sent from my phone

On Tue, Jan 31, 2023 at 11:50,
Cai Ortuñez <cortunez@granfoss.example> wrote:
> Hello Noor
>
> When do we settle the fence?"""


def old(spark, rows):
    got = {}
    for r in quoting.find_old_lines(records(spark, rows)).collect():
        got.setdefault(r["delivery_id"], set()).add(r["line_no"])
    return got


def test_marks_signatures_and_negatives(spark):
    got = old(spark, [{"id": 1, "content": MAIL, "from": "Noor Adebarin <noor@x.example>"}, {"id": 2}, {"id": 3, "content": ""}, {"id": 4, "kind": "file", "content": MAIL}, {"id": 5, "content": "no marks here, only text. " * 4000}, {"id": 1, "content": MAIL, "from": "Noor Adebarin <noor@x.example>"}])
    assert got == {1: {5, 6, 8, 9, 10, 11, 13, 15, 16, 17, 18, 19}}


def test_unmarked_history_is_found_by_its_sentences(spark):
    first = "Morning Noor,\n\nThe meter reading was 69 units higher than in March, so I asked the board to check it. We paid 370 GBP for the roof repair last Tuesday.\n\nCall me when the ferry tickets have come, please."
    reply = "Thanks, I will look at it on Friday and call the board.\n\nCheers\nNoor\n\n" + first.replace("\n\nThe", "\n\nThe").replace("last Tuesday", "last tuesday")
    rows = [{"id": 1, "thread": "t", "content": first, "uid": "a"}, {"id": 2, "thread": "t", "content": reply, "uid": "b", "from": "Noor <noor@x.example>"}, {"id": 3, "thread": "t", "content": first, "uid": "A "}]
    rows = records(spark, rows).withColumn("delivered_at", F.timestamp_seconds(F.col("delivery_id") * 1000))
    got = {}
    for r in quoting.find_old_lines(rows).collect():
        got.setdefault(r["delivery_id"], set()).add(r["line_no"])
    assert got == {2: {2, 3, 5, 7, 9}}  # copies of one message don't inherit from each other
    assert quoting.find_old_lines(rows.limit(0)).collect() == []
    assert {r["delivery_id"]: r["content"] for r in quoting.new_text(rows).collect()}[2] == "Thanks, I will look at it on Friday and call the board."


def test_boilerplate_is_what_recurs_under_a_senders_mails(spark):
    said = ["The boat leaves at noon tomorrow.", "We paid the roofer last week already.", "Who has the key to the shed now?", "My train was late again this morning.", "Bring two folding chairs on Sunday please."]
    foot = "Our heron desk never asks anybody for passwords.\nRoom {} of the old mill, second floor left, beside the tall green door and the long wooden stairs."
    mails = [{"id": k, "content": f"Hi Noor,\n{x}\n\n{foot.format(k + 20)}", "from": "Cai <cai@x.example>"} for k, x in enumerate(said)]
    once = [{"id": 10 + k, "content": f"{x}\n\n{foot.format(k)}", "from": f"Cai <cai{k}@x.example>"} for k, x in enumerate(said)]
    copies = [{"id": 20 + k, "content": said[0] + "\nOnly one message says this here.", "uid": "same", "from": "Bo <bo@x.example>"} for k in range(5)]
    alike = [{"id": 30 + k, "content": "Nothing is left to do today.", "from": "job@x.example"} for k in range(4)]
    assert old(spark, [*mails, *once, *copies, *alike]) == {k: {3, 4} for k in range(5)}


# Personal information

M = "id string, one_line string, action_summary string, synced_at timestamp, text string"


def test_personal_information(spark):
    body = "Hi Kofi\nCall me on (01632) 960 642 after six.\nCase number 525-6-5577768 is closed.\nSSN 994-43-9080 as requested.\nWrite to rada59[at]pixelgarn.example or kofi@boite.example\nLieferadresse: Ahorngasse 72, 82696 Ashcombe\nThe Heather Prize, follow @Kofi\nOrder 42329918, tracking 784499686750, 9 104,00 GBP, user@localhost\nKofi Beltranov"
    rows = records(spark, [{"id": k, "content": body if k == 1 else "x", "from": f"Kofi Beltranov <kofi{k}@b.example>"} for k in range(1, 4)] + [{"id": 9}, {"id": 10, "content": ""}, {"id": 11, "content": "plain words " * 20000}, {"id": None, "content": body}])
    messages = spark.createDataFrame([("gmail:p::1", "Plans, says Beltranov", "Ring 07700 900744", None, "x"), ("gmail:p::1", "Plans, says Beltranov", "Ring 07700 900744", None, "x"), (None, "Kofi", None, None, "x"), ("b", None, "", None, "x")], M)
    got = {tuple(r) for r in pii.find_personal(rows, messages).collect()}
    want = {(0, "name"), (1, "phone"), (3, "national_id"), (4, "email"), (5, "address"), (8, "name")}
    assert got == {("records", "1", "content", n, t) for n, t in want} | {("messages", "gmail:p::1", "one_line", 0, "name"), ("messages", "gmail:p::1", "action_summary", 0, "phone")}
    text = {r["row_key"]: r["redacted"] for r in pii.find_personal(rows, messages, with_text=True).filter("field = 'content'").collect()}["1"]
    assert text.startswith("Hi [NAME]\nCall me on [PHONE] after six.\nCase number 525-6-5577768") and "[EMAIL] or [EMAIL]" in text and "@Kofi" in text
    assert pii.find_personal(rows.limit(0), messages.limit(0)).collect() == []


def test_repeated_values_share_their_label():
    lexicon = pii.Lexicon(set())
    text = "ID: 997799-1234\n" + "some words\n" * 50 + "it was 997799-1234"
    assert [t for _, _, t in pii.find_spans(text, lexicon)] == ["national_id", "national_id"]
    assert pii.find_spans("was 997799-1234", lexicon) == []


def test_names_of_people_who_never_send(spark):
    lexicon = pii.Lexicon(set(), {pii._place("heron")})
    text = "Dear Olena,\nthe meeting with Olena Petrova is on Monday. Bring Mr Brandt along.\nPetrova knows the Report.\n\nKind regards\nBo"
    assert [text[a:b] for a, b, _ in pii.find_spans(text, lexicon)] == ["Olena", "Olena", "Petrova", "Brandt", "Petrova", "Bo"]
    assert pii.find_spans("Dear Customer,\nThe Report is in the Annex. Monday is Fine.\n\nKind regards\nHeron Works", lexicon) == []
    assert [t for _, _, t in pii.find_spans("Dear Heron,\nthanks", lexicon)] == ["name"]
    rows = records(spark, [{"id": 1, "content": "Meet Tikhon at noon and Li after that", "from": "tikhon.okonedu@x.example"}, {"id": 2, "content": "x", "from": "Li Ro <li@x.example>"}])
    messages = spark.createDataFrame([], M)
    assert {r["redacted"] for r in pii.find_personal(rows, messages, with_text=True).collect()} == {"Meet [NAME] at noon and [NAME] after that", "x"}


def test_messages_run_without_a_doubtful_node():
    lexicon = pii.Lexicon(set())
    text = "Tel: +47 91 23 45 67\nthen 91 23 45 67 it was\n> Tel: +47 91 23 45 67"
    assert [t for _, _, t in pii.find_spans(text, lexicon)] == ["phone"] * 3
    assert pii.find_spans("then 91 23 45 67 it was", lexicon) == []


def test_parts_left_out_of_the_field_keep_their_labels():
    rng = random.Random(6)
    for _ in range(300):
        scores = [{"name": rng.choice([-2.5, -0.4, 1.0, 2.2])} if rng.random() < 0.8 else {"phone": rng.uniform(-3, 3), "national_id": rng.uniform(-3, 3)} for _ in range(6)]
        edges = [(a, a + 1, rng.choice([pii.CHAIN, pii.SKIP])) for a in range(5) if rng.random() < 0.5]
        assert pii._labels(scores, edges) == pii._settle(scores, edges)


# Leaks

BODY = "According to ledger 2196, 2533 oak casks were swapped with great care for 1330 linen sacks near Brackwater at 10:03 while the kite judge of Ystgard counted 1389 russet crates and kept copy 1065 for Oddervik"


@pytest.fixture(scope="module")
def leaks(spark):
    w = BODY.split()
    exact, short = " ".join(w[3:20]), " ".join(w[3:16])
    changed = " ".join([*w[2:8], "walnut", *w[9:16], "tin", *w[17:24]])
    other = BODY.replace("2196", "17").replace("2533", "18").replace("1330", "19").replace("Brackwater", "Lowmere").replace("10:03", "9:01").replace("Ystgard", "Elmsund").replace("1389", "20").replace("russet", "teal").replace("1065", "21").replace("oak", "tin").replace("linen", "jute")
    rows = [(1, f"Before that. {exact} And after."), (2, short), (3, f"<b>{changed.upper()}</b>"), (4, other), (5, None), (6, ""), (7, "> " + "\n> ".join(exact.replace(" ", "  ").replace("a", "a­").split(" "))), (8, "plain words and nothing else " * 5000), (None, exact), (1, f"Before that. {exact} And after.")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, words string")
    items = spark.createDataFrame([(10, BODY, "c"), (11, None, "c"), (12, "too short", "c"), (13, BODY, "c")], "item_id bigint, body string, doc_id string")
    return docs, items


def test_leaks(leaks):
    docs, items = leaks
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items).collect()}
    assert got == {(d, i) for d in (1, 3, 7) for i in (10, 13)}
    assert leakage.find_leaks(docs.limit(0), items).collect() == [] and leakage.find_leaks(docs, items.limit(0)).collect() == []
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items, items_per_block=1).collect()} == got


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_alignment_against_brute_force():
    rng = random.Random(2)
    words = [w for w in leakage.words_of(BODY) if w.isalpha()] + ["alpha", "beta", "gamma", "delta"]
    found = 0
    for _ in range(120):
        body = rng.choices(words, k=22)
        text = list(body[rng.randrange(4) :])
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(text))
            text[k : k + rng.randint(0, 1)] = rng.choice(([], ["zzz"], ["yyy", "xxx"]))
        text = ["q", *text, "r"]
        best = 0
        for i in range(len(body)):
            for n in range(15, len(body) - i + 1):
                if n > best and any(text[p] == body[i] and text[p + m - 1] == body[i + n - 1] and distance(body[i : i + n], text[p : p + m]) * 8 <= n for p in range(len(text)) for m in range(n - n // 8, n + n // 8 + 1) if p + m <= len(text)):
                    best = n
        got = leakage.longest_leak(text, leakage.Item(1, body))
        # with repeated words an end may agree with another copy of its word, which lengthens a stretch but makes none
        assert (got is not None) == (best > 0) and (not got or best - 3 <= got[0] <= best), (body, text, got, best)
        found += best > 0
    assert 40 < found < 120


def test_long_gaps_and_other_figures():
    body = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    item = leakage.Item(1, body)
    assert leakage.longest_leak([*body[:14], "w", "x", "y", "z", *body[18:32]], item) == (32, 4)
    assert leakage.longest_leak(body[:14], item) is None
    assert leakage.longest_leak([*body[:7], "w", *body[8:14]], item) is None
    figures = leakage.Item(2, [*body[:10], "17", *body[11:20]])
    assert leakage.longest_leak([*body[:10], "18", *body[11:20]], figures) is None and leakage.longest_leak([*body[:10], "word", *body[11:20]], figures) == (20, 1)


# Mixing

def test_mixture_reaches_its_shares(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(WORDS, k=20)), s, "x") for k, s in enumerate(["Big Source"] * 1200 + ["small-source"] * 200 + [None, "other"])] + [(5000, None, "big_source", "x"), (5001, "", "BIG SOURCE", "x"), (None, "a", "big source", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string")
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small_source", 0.4, 4), ("missing", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.shares(docs, targets).collect()}
    assert abs(got["big_source"]["actual_share"] - 5 / 9) < 0.05 and abs(got["small_source"]["actual_share"] - 4 / 9) < 0.05 and got["missing"]["used_tokens"] == 0
    assert got["big_source"]["most_copies"] <= 1 and got["small_source"]["most_copies"] <= 4
    a, b = ([tuple(r) for r in mixing.mix(docs, targets).select("doc_id", "copy").collect()] for _ in range(2))
    assert a == b and a != sorted(a)
    assert mixing.mix(docs.limit(0), targets).collect() == [] and mixing.mix(docs, targets.limit(0)).collect() == []


@pytest.mark.parametrize("cap", [1, 2, 4])
def test_rates_invert_the_capped_mean(cap):
    for mean in (0.1, 0.5, 0.9 * cap):
        assert abs(mixing.capped_mean(mixing.poisson_rate(mean, cap), cap) - mean) < 1e-9


# Spam pages

def test_spam_pages(spark):
    rng = random.Random(4)
    keys = ["cheap flights", "city break", "hotel discount", "book online"]
    prose = "The people at the club promised an answer by Friday, yet nothing has come so far. We looked at the boat again and think that it should wait until May. "
    rows = [
        (1, " ".join(rng.choices(keys, k=60))), (2, " ".join(f"#{k.replace(' ', '')}{i}" for i, k in enumerate(keys * 10))), (3, " | ".join(f"{rng.choice(keys).title()} - shop{i}.example" for i in range(40))),
        (4, "".join(f'<a href="/t/{i}">{rng.choice(keys)}</a>, ' for i in range(40))), (5, prose * 8), (6, "Receipt 12\n" + "\n".join(f"{i} x quiet label  {i}78,00" for i in range(1, 15)) + "\n" + prose), (7, prose * 6 + " ".join(rng.choices(keys, k=10))),
        (8, "\n".join(f"https://a-{i}.example/x - The people at the club promised an answer by Friday, yet nothing has come so far." for i in range(5))), (9, "\n".join(["> " * k + prose for k in range(4)])), (10, ""), (11, None), (12, "!!! ???"), (1, " ".join(keys * 20)), (None, "x"),
    ]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, pieces string")
    got = {r["doc_id"] for r in spam.score_pages(docs).filter("is_spam").collect()}
    assert got == {1, 2, 3, 4}
    assert spam.score_pages(docs.limit(0)).collect() == []


def test_pages_of_repeated_or_few_words_in_short_lines(spark):
    prose = "The people at the club promised an answer by Friday, yet nothing has come so far. We looked at the boat again and think that it should wait until May. "
    towns = ["oslo", "bergen", "paris", "lyon", "madrid", "berlin", "krakow", "moscow"]
    rotating = [f"{a} {b}" for a in ("cheap", "best", "last", "city") for b in ("flights", "hotels", "breaks", "deals", "tours")]
    rows = [
        (1, "\n".join(["buy cheap viagra"] * 200)), (2, "\n".join(f"cheap flights {t}" for t in towns * 3)), (3, "\n".join(["flights", "hotels", "insurance", "mortgage"] * 20)), (4, "\n".join(rotating * 10)),
        (5, "\n".join(["> " * k + line for k in range(4) for line in ("Hi all", "The boat leaves at noon.", "Best regards", "Noor")]) + prose), (6, "\n".join(["Milk", "Rye bread", "Butter", "Apples", "Oat flakes", "Coffee", "Tea", "Salt", "Candles", "Soap", "Matches", "Eggs"])),
        *[(10 + k, prose * 4) for k in range(4)],
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"] for r in spam.score_pages(docs).filter("is_spam").collect()}
    assert got == {1, 2, 3, 4}


def test_pages_of_languages_without_a_list(spark):
    prose = "The people at the club promised an answer by Friday, yet nothing has come so far. We looked at the boat again and think that it should wait until May. "
    turkish = "Dün akşam sahilde uzun bir yürüyüş yaptık. Deniz sakindi, gökyüzü ise bulutsuzdu. Çocuklar kumdan kaleler kurdular. Sonra küçük bir lokantada balık yedik. "
    hungarian = "Tegnap este hosszú sétát tettünk a parton. Nyugodt volt a tenger, felhőtlen az égbolt. Gyerekek homokvárakat építettek. Később egy kis étteremben halat ettünk. "
    japanese = "昨日の夕方、海岸を長く散歩しました。\n海は穏やかで、空には雲がありませんでした。\n子供たちは砂の城を作っていました。\n"
    keys = ["cheap flights", "city break", "hotel discount", "book online"]
    rows = [(1, turkish), (2, hungarian), (3, japanese), (4, turkish * 3), *[(10 + k, prose + " ".join(keys)) for k in range(6)], (20, " ".join(random.Random(4).choices(keys, k=60)) + ".")]
    got = {r["doc_id"] for r in spam.score_pages(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("is_spam").collect()}
    assert got == {20}


def test_repairs_replace_whole_words_once(spark):
    rows = [("Ú ÚTIL ÚÚ\nÚ", {"Ú": "é", "é": "x"}), (None, {"a": "b"}), ("a", None), ("", {"a": "b"})]
    df = spark.createDataFrame(rows, "t string, f map<string,string>")
    assert [r["t"] for r in df.select(encoding.repaired(F.col("t"), F.col("f")).alias("t")).collect()] == ["é ÚTIL ÚÚ\né", None, "a", ""]


def test_planted_texts_are_given_back(spark):
    good, rng = sentences_of(400), random.Random(8)
    chains = [("utf8", "cp1252"), ("utf8", "mac_roman"), ("cp1252", "mac_roman"), ("utf8", "cp1251")]
    bad = {k: good[k].encode(chains[k % 4][0]).decode(chains[k % 4][1], "replace") for k in rng.sample(range(400), 60)}
    rows = [{"id": k, "content": bad.get(k, t)} for k, t in enumerate(good)]
    df = records(spark, rows).select("delivery_id", "content")
    found = encoding.find_garbled(records(spark, rows)).filter("field = 'content'").select("delivery_id", "fixes")
    got = {r["delivery_id"]: r["c"] for r in df.join(found, "delivery_id").select("delivery_id", encoding.repaired(F.col("content"), F.col("fixes")).alias("c")).collect()}
    lossless = [k for k in bad if "�" not in bad[k] and bad[k] != good[k]]
    assert sum(got.get(k) == good[k] for k in lossless) >= 0.9 * len(lossless)
    assert not set(got) - set(bad)


def test_large_rates_and_their_limits():
    assert abs(mixing.poisson_rate(720, 1000) - 720) < 1 and mixing.capped_mean(5000.0, 3) == pytest.approx(3)
    assert mixing.shares_below(0.0, 2) == [1.0, 1.0] and mixing.shares_below(float("inf"), 2) == [0.0, 0.0]


def test_long_signatures_and_history_above_a_reply(spark):
    sign = "\n".join(["--", "Noor Adebarin", *[f"Tel. 07700 9007{k:02}" for k in range(22)]])
    first = "The meter reading was 69 units higher than in March, so I asked the board to check it. We paid 370 GBP for the roof repair last Tuesday. Call me when the ferry tickets have come, please."
    edited = first.replace("higher than", "higher then")
    rows = [
        {"id": 1, "content": "It stays as it is, see you on Monday.\n\n" + sign, "from": "Noor Adebarin <n@x.example>", "uid": "s"},
        {"id": 2, "thread": "t", "content": "Hi Noor,\n" + first, "uid": "a", "from": "Cai <cai@x.example>"}, {"id": 3, "thread": "t", "content": f"{first}\n\nThanks, I will look at it on Friday and talk to the board.", "uid": "b", "from": "Noor <noor@x.example>"},
        {"id": 4, "thread": "t", "content": f"I will look at it on Friday and talk to the board.\n\n{edited}", "uid": "c", "from": "Bo <bo@x.example>"},
    ]
    df = records(spark, rows).withColumn("delivered_at", F.timestamp_seconds(F.col("delivery_id") * 1000))
    got = {}
    for r in quoting.find_old_lines(df).collect():
        got.setdefault(r["delivery_id"], set()).add(r["line_no"])
    assert got == {1: set(range(2, 26)), 3: {0}, 4: {2}}


def test_edited_sentences_meet_in_the_tables():
    rng, words = random.Random(9), [f"word{k}" for k in range(3000)]
    for changed, least in ((1, 0.9), (2, 0.75), (3, 0.5)):
        hit = 0
        for _ in range(300):
            a = rng.choices(words, k=30)
            b = list(a)
            for k in rng.sample(range(30), changed):
                b[k] = rng.choice(words)
            sums, sizes, _, _ = quoting.bit_sums([a, b])
            x, y = (int(v) & (1 << 64) - 1 for v in quoting.simhash(sums, sizes))
            meet = any((x >> at) % (1 << n) == (y >> at) % (1 << n) for at, n in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12)))
            hit += meet and bin(x ^ y).count("1") <= 10
        assert hit / 300 >= least, (changed, hit)


def test_similar_spans_and_fitted_weights():
    lexicon = pii.Lexicon(set())
    text = "Ask Kofi about the Report.\nwrite to kofi.beltranov@boite.example or to the office"
    assert [(text[a:b], t) for a, b, t in pii.find_spans(text, lexicon)] == [("Kofi", "name"), ("kofi.beltranov@boite.example", "email")]
    known = pii.Lexicon({pii._place("anna")})
    chain, skip, similar = pii.fit_weights(["Anna Anna met Anna. Tel: +47 91 23 45 67"] * 30, known)
    assert all(pii.LEAST_WEIGHT <= w <= pii.MOST_WEIGHT for w in (chain, skip, similar)) and similar == pii.SIMILAR
    rng = random.Random(7)
    for _ in range(200):
        scores = [{"name": rng.choice([-2.5, -0.4, 1.0, 2.2])} for _ in range(7)]
        edges = [(a, b, rng.choice([0.5, 2.0])) for a in range(7) for b in range(a + 1, 7) if rng.random() < 0.3]
        want = [bool(x) for x in pii._settle(scores, edges)]
        assert pii._settle_pairs([x["name"] for x in scores], edges) == want


def test_near_sentences_are_found_beside_any_number_of_others(spark):
    # two pairs of sentences 8 bits apart that share one part of thirteen bits, in a thread with as many others as given
    x, y = 0b1111, 0b1111 | 1 << 13 | 1 << 14 | 1 << 26 | 1 << 27 | 1 << 39 | 1 << 40 | 1 << 52 | 1 << 60
    words = "abcdefghijklmnopqrst"

    def mail(i, print_, first):
        return (i, i, 1, i * 10_000_000, i, [], [], [0, 1], [0, 1], [10, 10], [False, False], [print_, 7], [first + words[1:10], words[10:]], [0], [print_], [i], [0])

    for others in (0, 1 << 18):
        rows = spark.createDataFrame([mail(1, x, "a"), mail(2, y, "z")], quoting.PARSED)
        many = f"transform(sequence(1, {others}), k -> {{}})" if others else "array()"
        filler = spark.createDataFrame([mail(3, 99, "q")], quoting.PARSED).selectExpr(
            *[c for c in rows.columns if not c.startswith("part")], f"cast({many.format('0')} as array<int>) parts", *[f"cast({many.format('5')} as array<bigint>) {c}" for c in ("part_prints", "part_hashes", "part_figures")],
        )
        hits = quoting.inherited(rows.unionByName(filler)).collect()
        assert [(r["delivery_id"], r["source"], r["exact"]) for r in hits if r["delivery_id"] < 3] == [(2, 1, False)], others


def test_sentences_of_one_bucket_have_centres_of_their_own(spark):
    # a common sentence, and two near ones that share only the part which all three share
    common, one = 1, 1 | 0b11111 << 13 | 0b11111 << 26
    other = one ^ (1 << 20 | 1 << 33 | 1 << 46 | 1 << 60)
    said = [[common, *([one] if i < 3 else []), *([other] if 3 <= i < 5 else [])] for i in range(8)]
    rows = [(i, i, 1, i, 1, [], [], [0] * len(p), [0] * len(p), [9] * len(p), [False] * len(p), p, ["w"] * len(p), [], [], [], []) for i, p in enumerate(said)]
    levels, _ = quoting.recurring(spark.createDataFrame(rows, quoting.PARSED))
    assert {r["print"]: r["level"] for r in levels.collect()} == {common: 3, one: 3, other: 3}


def test_weights_are_fitted_on_all_texts(spark):
    # of many texts thirty tell how little it says that a number was a phone number elsewhere
    ids = [r["id"] for r in spark.range(2100).orderBy(F.xxhash64("id")).collect()]
    late = set(ids[-30:])
    said = "Tel: +47 91 23 45 67\nthen 91 23 45 67 it was"
    rows = [{"id": k, "content": said if k in late else "nothing to see here"} for k in ids[:-1]]
    rows.append({"id": ids[-1], "content": "Tel: +47 91 23 45 67\nthen 91 23 45 67 it was\n> Tel: +47 91 23 45 67"})
    messages = spark.createDataFrame([], "id string, one_line string, action_summary string, synced_at timestamp")
    found = {(r["line_no"], r["entity_type"]) for r in pii.find_personal(records(spark, rows), messages).filter(f"row_key = '{ids[-1]}'").collect()}
    assert found == {(0, "phone"), (2, "phone")}
    redacted = {r["row_key"]: r["redacted"] for r in pii.find_personal(records(spark, rows), messages, with_text=True).collect()}
    assert len(redacted) == 2100 and redacted[str(ids[-1])] == "Tel: [PHONE]\nthen 91 23 45 67 it was\n> Tel: [PHONE]"
