from helixframe.llm import chat_format, url_filter

CONV = "conv_id long, turn long, role string, text string, h1 string"


def test_prefixes_and_copies_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    logs = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: [("user", "hi"), ("assistant", "other")], 6: [("user", None)]}
    rows = [(c, t, r, x, "clash") for c, turns in logs.items() for t, (r, x) in enumerate(turns)]
    rows += [rows[0], (None, 0, "user", "lost", ""), (7, None, None, "no turn", "")]
    got = {r.conv_id: r for r in chat_format.format_chats(spark.createDataFrame(rows, CONV)).collect()}
    assert sorted(got) == [3, 5, 6, 7]
    assert (got[3].n_turns, got[3].n_copies) == (3, 2)
    assert got[3].text == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in a)
    assert got[6].text == "<|im_start|>user\n<|im_end|>\n"
    assert got[7].text.startswith("<|im_start|>unknown\n")


def test_no_conversations(spark):
    assert chat_format.format_chats(spark.createDataFrame([], CONV)).count() == 0


def test_same_turns_in_another_order_are_no_prefix(spark):
    rows = [(1, 0, "user", "a", ""), (1, 1, "user", "b", ""), (2, 0, "user", "b", ""), (2, 1, "user", "a", ""), (2, 2, "user", "c", "")]
    assert {r.conv_id for r in chat_format.format_chats(spark.createDataFrame(rows, CONV)).collect()} == {1, 2}


URLS = {
    "https://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
    "http://example.net/fr/": ("example.net", "/fr/", "net/", "block"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
    "http://x.example.com/de/1": ("x.example.com", "/de/1", "example.com/de/", "block"),
    "http://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"),
    "http://b.net?x": ("b.net", "", None, "allow"),
    "no scheme/x": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://" + "l." * 500 + "net/" + "d/" * 3000: ("l." * 500 + "net", "/" + "d/" * 3000, "net/", "block"),
}


def test_urls_are_judged_on_both_ways_of_joining(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    rules = url_filter.rules_frame(spark, url_filter.RULES)
    for most in (500_000, 0):
        got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, broadcast_rules=most).collect())
        assert got == sorted([(i, *want) for i, want in enumerate(URLS.values())] * 2)


def test_rules_need_no_slash_at_their_end_and_block_wins_ties(spark):
    pages = spark.createDataFrame([(1, "http://a.b/abc/d"), (2, "http://a.b/ab")], "page_id long, url string")
    rules = url_filter.rules_frame(spark, [("a.b", "/ab", "allow"), ("a.b", "/ab", "block"), ("a.b", "/abc/", "allow")])
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules).collect()} == {1: "allow", 2: "block"}
