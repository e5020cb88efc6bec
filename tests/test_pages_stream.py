import json
import os

import pytest

from quillspark.sources import html
from quillspark.streaming import rescore

NEST = """<shreddit-post id="p"><h1 slot="title">A practical repair note from this weekend</h1><div slot="text">I replaced the loose hinge.</div></shreddit-post>
<shreddit-comment id="a"><div slot="comment">Parent words here.</div><shreddit-comment id="b"><div slot="comment">Child words.</div></shreddit-comment></shreddit-comment>"""


def test_reddit_ownership():
    assert html.extract(NEST, "reddit") == [("p", "post", "A practical repair note from this weekend\nI replaced the loose hinge."), ("a", "comment", "Parent words here."), ("b", "comment", "Child words.")]
    folded = '<div class="thing self" id="t"><a class="title">A title that is long enough</a><div class="usertext-body">Well: a title that is long enough, and more</div></div>'
    assert html.extract(folded, "reddit") == [("t", "post", "Well: a title that is long enough, and more")]


def test_linkedin_layouts():
    full = "We completed the migration after testing every stage. Those details are clipped until expansion."
    feed = lambda extra: f'<main><div data-testid="mainFeed"><div id="m"><div data-testid="expandable-text-box">{full}{extra}</div></div><div aria-label="loading"></div></div></main>'
    a, b = html.extract(feed('<button aria-label="see more">…more</button>'), "linkedin"), html.extract(feed('<button aria-label="see less">see less</button>'), "linkedin")
    assert a == b == [("m", "post", full)]
    generated = """<div class="feed-shared-update-v2" id="g"><div class="update-components-actor__container"><span>Example Author and profile metadata that is quite long</span></div>
      <div class="x"><div class="y">We shipped the revised workflow after testing it with four teams. <button>see more</button></div></div>
      <div class="social-details-social-counts"><button>42 reactions</button></div></div>"""
    assert html.extract(generated, "linkedin") == [("g", "post", "We shipped the revised workflow after testing it with four teams.")]
    nested = '<div class="feed-shared-update-v2" id="o"><div class="update-components-text">Outer text</div><li class="comments-comment-item" id="c"><span class="comments-comment-item__main-content">A much longer comment text</span></li></div>'
    assert html.extract(nested, "linkedin") == [("o", "post", "Outer text"), ("c", "comment", "A much longer comment text")]
    item = '<div role="listitem" id="l"><p><span data-testid="expandable-text-box">Two years apart.</span></p><button>Like</button></div>'
    assert html.extract(item, "linkedin") == [("l", "post", "Two years apart.")]


def test_x_replies():
    page = '<article role="article" id="1"><div data-testid="tweetText">Short</div><div data-testid="tweetText">Longer text</div></article><article role="article" id="2"><div data-testid="socialContext">Replying to @a</div><div data-testid="tweetText">Reply\xa0text</div></article>'
    assert html.extract(page, "x") == [("1", "post", "Longer text"), ("2", "comment", "Reply text")]


@pytest.mark.parametrize("broken", [None, "", "<div", "<p>a<p>b", "</div></div>x", "<li>a<li>b<ul><li>c</ul>"])
def test_broken_pages(broken):
    for p in html.ADAPTERS:
        html.extract(broken, p)


def test_page_frames(spark):
    pages = spark.createDataFrame([(1, NEST), (2, None)], "page_id long, html string")
    assert html.elements(pages, "reddit").count() == 3 and html.elements(pages, "reddit", comments=False).count() == 1
    with pytest.raises(ValueError):
        html.elements(pages, "elsewhere")


def test_stream_scores_changes_only(spark, tmp_path):
    src, schema = tmp_path / "in", "element_id string, seq long, platform string, kind string, text string"
    src.mkdir()
    for i, batch in enumerate([[(0, "A"), (1, "A")], [(2, "B")], [(3, "A")], [(4, "A"), (3, "old")]]):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"element_id": "e", "seq": s, "platform": "x", "kind": "post", "text": f"{t} text."}) for s, t in batch))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    got = []
    q = rescore.rescore(stream, lambda df, n: got.extend(r.seq for r in df.select("seq", "label").collect()), str(tmp_path / "ck"), once=True)
    q.awaitTermination(120)
    assert got == [0, 2, 3]


def test_collapse_takes_latest():
    import pandas as pd

    class State:
        hasTimedOut, exists, value = False, False, None

        def update(self, v):
            self.exists, self.value = True, v

        get = property(lambda self: self.value)

    f = pd.DataFrame({"seq": [2, 1], "platform": "x", "kind": "post", "text": ["b", "a"], "fingerprint": ["fb", "fa"]})
    out = list(rescore._collapse(("e",), iter([f]), State(), 0, True))
    assert out[0].seq.tolist() == [2] and out[0].text.tolist() == ["b"]


def test_changes_replay_runs_the_stream(spark, monkeypatch):
    """The registered query counts what the stream's own step gives, as its SQL does."""
    from quillspark.plans import registry
    from quillspark.streaming import rescore

    d, calls, replay = "/root/testdata/sf0.001", [], rescore.replay
    monkeypatch.setattr(rescore, "replay", lambda rows: calls.append(1) or replay(rows))
    got = dict(map(tuple, registry.changes_replay(spark, d).collect()))
    want, before = {}, {}
    for r in sorted(spark.read.parquet(f"{d}/events.parquet").collect(), key=lambda r: (r.ts, r.event_id)):
        want[r.user_id] = want.get(r.user_id, 0) + (r.user_id not in before or before[r.user_id] != r.event_type)
        before[r.user_id] = r.event_type
    assert calls and got == want


def test_references_cut_short():
    """A plain page's reference counts with its semicolon only, as the SQL of its queries has it; sites are read as browsers do."""
    page = "<h1>Salt &amp; oil &amp</h1><article><h1>Salt &amp; oil &amp</h1><p>Salt &amp; oil &amp; &lt;b&gt; &#233; &ampere; &copy</p></article>"
    assert html.extract(page, "page") == [("post-0", "post", "Salt & oil &ampSalt & oil & <b> é &ampere; &copy")]
    assert html.extract('<article role="article" id="1"><div data-testid="tweetText">R &amp</div></article>', "x") == [("1", "post", "R &")]
