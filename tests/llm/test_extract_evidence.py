import random

import pytest

from bandwright.llm import extract
from test_extract import SCHEMA, text, varied

FRAMES = {
    # a name that holds a clutter's word and another; varying text, no links
    "named": '<body><nav><a href=/>Home</a></nav><article class=post><h1>{0}</h1><p>{1}</p><div class="social-history"><p>{2}</p><p>{3}</p></div></article><footer>us</footer></body>',
    # a class of the page's own
    "own": '<body><nav><a href=/>Home</a></nav><article class="post post-{4}"><h1>{0}</h1><p>{1}</p><div class="body-{4}"><p>{2}</p><p>{3}</p></div></article><footer>us</footer></body>',
    # real comments vary too, and go
    "comments": '<body><article class=post><h1>{0}</h1><p>{1}</p><p>{2}</p><p>{3}</p><section class="comments-area"><div class="comment-body"><p>{5}</p></div></section></article></body>',
    # an unsure name over links
    "links": '<body><article class=post><h1>{0}</h1><p>{1}</p><p>{2}</p><p>{3}</p><div class="related-quarrels"><a href=/a>{5}</a></div></article></body>',
}


def site(frame, n=60):
    rng, pages, texts = random.Random(frame), [], {}
    for k in range(n):
        parts = [varied(rng, 3), varied(rng, 25), varied(rng, 20), varied(rng, 20)]
        own = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
        pages.append((k, f"http://{frame}.org/{k}", FRAMES[frame].format(*parts, own, varied(rng, 12))))
        texts[k] = "\n\n".join(parts)
    return pages, texts


@pytest.mark.parametrize("frame", FRAMES)
def test_evidence_decides(spark, frame):
    pages, texts = site(frame)
    rows = {r["page_id"]: r for r in extract.extract(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert len(rows) == 60 and all(r["wrapped"] for r in rows.values())
    assert {k: r["text"] for k, r in rows.items()} == texts


def test_many_containers_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(extract, "BROADCAST_KEYS", 0)
    pages, texts = site("own")
    assert {r["page_id"]: r["text"] for r in extract.extract(spark.createDataFrame(pages, SCHEMA)).where("wrapped").collect()} == texts


def test_names_of_one_page():
    assert text("<article><p>a</p><div class='comment-free'><p>one two</p></div><div class='comment-list'><p>three</p></div></article>") == ["a", "one two"]
