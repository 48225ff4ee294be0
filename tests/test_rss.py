import importlib.util
import subprocess
import sys

from seekmill.plans.server import answer
from seekmill.sources import readers

ITEM = "<item><title>{}</title><link>l</link><content>{}</content></item>"


def feed(*channels):
    return "<rss>" + "".join(f"<channel><title>c</title>{c}</channel>" for c in channels) + "</rss>"


def read(spark, tmp_path, text):
    (tmp_path / "f.xml").write_text(text)
    return [(r["title"], r["content"]) for r in readers.read_rss(spark, str(tmp_path / "f.xml")).collect()]


def test_entities_without_a_definition_stay(spark, tmp_path):
    assert readers._items(feed(ITEM.format("a&nbsp;b &amp; caf&eacute;", "&x;")))[0] == {"title": "a&nbsp;b & caf&eacute;", "link": "l", "content": "&x;"}
    assert read(spark, tmp_path, feed(ITEM.format("t", "one&nbsp;two &#8211; three"))) == [("t", "one two – three")]
    assert readers._items('<!DOCTYPE rss [<!ENTITY x "known">]>' + feed(ITEM.format("&x;&y;", "c")))[0]["title"] == "known&y;"


def test_items_of_the_first_channel_only(spark, tmp_path):
    assert read(spark, tmp_path, feed(ITEM.format("1", "a") + ITEM.format("2", "b"), ITEM.format("3", "c"))) == [("1", "a"), ("2", "b")]


def test_text_before_a_child_counts(spark, tmp_path):
    tags = ["a<b>x</b>c", "<b>x</b>c", "a<!-- no -->b", "<!-- no -->b", "\n  <![CDATA[in <b>]]>after", "a<![CDATA[b]]>", "<![CDATA[&nbsp;]]>", ""]
    items = readers._items(feed("".join(ITEM.format(t, "c") for t in tags)))
    assert [i["title"] for i in items] == ["a", "", "a", "b", "in <b>", "a", "&nbsp;", ""]
    assert readers._items(feed("<item><title>1</title><title>2</title><media><title>3</title></media></item>"))[0]["title"] == "1"


def test_malformed_feeds_and_items_without_content(spark, tmp_path):
    good = feed(ITEM.format("t", "c"))
    for bad in (good[:-1], good.replace("</item>", "", 1), "", "no xml", good + "<x>", "<rss><channel><item><title>&#xFFFFFF;</title></item></channel></rss>"):
        assert readers._items(bad) == []
    items = "".join(f"<item><title><![CDATA[t{i}]]></title>\r\n<news_id>{i}</news_id><link>l{i}</link><guid>g</guid><pubDate>d</pubDate></item>\r\n" for i in range(50))
    assert len(readers._items(feed(items))) == 50 and read(spark, tmp_path, feed(items)) == []


def test_a_client_asks_for_a_bounded_page():
    class Service:
        def search_json(self, q, k):
            return f'"{k}"'

    assert answer(Service(), "GET", "/search?q=a&k=1000") == (200, '"1000"')
    assert answer(Service(), "GET", "/search?q=a&k=1001")[0] == 400


def test_the_entry_names_what_is_absent():
    """Without the training-data subpackage or a library of its own the other queries stay; a fault inside it shows."""
    code = "import sys; sys.modules[{!r}] = None; import __spark_entry__ as e; print('tokenize' in e.queries())"
    run = lambda name: subprocess.run([sys.executable, "-c", code.format(name)], capture_output=True, text=True)
    for name in ("seekmill.llm", "seekmill.llm.queries", "public_tokenizers", "corpus_pipeline"):
        assert run(name).stdout.split() == ["True"], name
    if importlib.util.find_spec("seekmill.llm"):
        assert "seekmill.llm.storage" in run("seekmill.llm.storage").stderr
