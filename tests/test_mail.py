"""Forwarded mails of common programs, nested ones, and the main part of pages."""

import json

import pytest

from corpusloom.functions import documents as D
from corpusloom.functions import mail as M
from corpusloom.functions import markup


def mail(subject, body, kind="text/html", sender="Me <me@home.example>"):
    return f"From: {sender}\r\nSubject: {subject}\r\nDate: Tue, 5 May 2026 10:00:00 +0200\r\nMessage-ID: <outer@home>\r\nContent-Type: {kind}; charset=utf-8\r\n\r\n{body}".encode()


HEADERS = "From: Bo Ray &lt;bo@letters.example&gt;<br>Date: Mon, 8 Jun 2026 12:00:00 +0000<br>Subject: The Issue<br>To: me<br>"
BODY = "<h1>The Issue</h1><p>First words.</p><h1>Next</h1>"
PAGES = {
    "gmail": f'<p>See this.</p><div class="gmail_quote"><div class="gmail_attr">---------- Forwarded message ---------<br>{HEADERS}</div>{BODY}</div>',
    "outlook": f'<p>See this.</p><div id="divRplyFwdMsg">{HEADERS.replace("Date", "Sent")}</div>{BODY}',
    "yahoo": f'<p>See this.</p><div class="yahoo_quoted"><div>----- Forwarded Message -----<br>{HEADERS}</div>{BODY}</div>',
    "thunderbird": '<p>See.</p><div class="moz-forward-container"><table class="moz-email-headers-table"><tr><td>From: Bo Ray &lt;bo@letters.example&gt;</td></tr><tr><td>Date: Mon, 8 Jun 2026 12:00:00 +0000</td></tr><tr><td>Subject: The Issue</td></tr></table>' + BODY + "</div>",
    "apple-mail": '<p>See.</p><blockquote type="cite"><div>Begin forwarded message:</div><br><div><b>From: </b>Bo Ray &lt;bo@letters.example&gt;</div><div><b>Subject: </b>The Issue</div><div><b>Date: </b>Mon, 8 Jun 2026 12:00:00 +0000</div><div><b>Reply-To: </b>x@y</div><br><div>' + BODY + "</div></blockquote>",
}


@pytest.mark.parametrize("client", sorted(PAGES))
def test_clients(client):
    got = M.parse_mail(mail("Fwd: The Issue", PAGES[client]))
    assert (got["subject"], got["from_name"], got["from_email"], got["message_id"], got["source_message_id"]) == ("The Issue", "Bo Ray", "bo@letters.example", "<outer@home>", None)
    assert got["forward"] == {"detected": True, "depth": 1, "hops": [{"client": client, "confidence": 0.95, "signals": M.SIGNALS[client]}], "confidence": 0.95}
    assert got["delivery"]["from_email"] == "me@home.example" and str(got["sent_at"]) == "2026-06-08 12:00:00+00:00"
    body = got["body_html"]
    assert "First words." in body and "See" not in body and "Forwarded" not in body and "From" not in body and "Reply-To" not in body
    assert ("The Issue" in body) == (client == "apple-mail")  # only a heading at the top, not one inside a div, repeats the subject
    assert "<h2>Next</h2>" in body and "<h1>" not in body
    assert got["source"] == {"name": "Letters", "url": None, "sender_alias": "@letters.example", "source": "sender-domain", "confidence": 0.6} and got["extraction_version"] == 3
    assert json.loads(got["provenance"])["forward"]["hops"][0]["client"] == client


def test_replies_are_no_forwards():
    for subject in ("Re: The Issue", "AW: The Issue"):
        assert not M.parse_mail(mail(subject, PAGES["outlook"]))["forwarded"]
    assert not M.parse_mail(mail("The Issue", PAGES["outlook"]))["forwarded"]  # the wrapper of replies, too
    quoted = '<p>Yes.</p><div class="gmail_quote"><div class="gmail_attr">On Mon, Bo wrote:</div><blockquote>Hi</blockquote></div>'
    got = M.parse_mail(mail("Re: Hi", quoted))
    assert not got["forwarded"] and "Yes." in got["body_html"] and got["forward"]["confidence"] == 1.0


def test_nested_forwards():
    inner = "Begin forwarded message:\n\nFrom: Cy Poe <cy@news.example>\nSubject: Deepest\nDate: Mon, 8 Jun 2026 12:00:00 +0000\n\nThe words."
    outer = f"---------- Forwarded message ---------\nFrom: Bo <bo@x.example>\nSubject: Fwd: Deepest\nTo: me\n\n{inner}"
    got = M.parse_mail(mail("Fwd: Fwd: Deepest", outer, "text/plain"))
    assert got["forward"]["depth"] == 2 and got["forward"]["confidence"] == 0.9 and got["from_name"] == "Cy Poe" and got["body_html"] == "<p>The words.</p>"
    attached = mail("Fwd: x", "see", "text/plain").replace(b"Content-Type: text/plain; charset=utf-8\r\n\r\nsee", b"Content-Type: multipart/mixed; boundary=B\r\n\r\n--B\r\nContent-Type: text/plain\r\n\r\nsee\r\n--B\r\nContent-Type: message/rfc822\r\n\r\n" + mail("Fwd: Deepest", outer, "text/plain").replace(b"<outer@home>", b"<middle@x>") + b"\r\n--B--\r\n")
    got = M.parse_mail(attached)
    assert [h["client"] for h in got["forward"]["hops"]] == ["attached-message", "plain", "plain"] and got["forward_kind"] == "rfc822" and got["message_id"] == "<outer@home>"
    many = "x"
    for _ in range(9):
        many = f"---- Forwarded message ----\nFrom: a <a@b.example>\nSubject: s\nTo: me\n\n{many}"
    assert M.parse_mail(mail("Fwd: s", many, "text/plain"))["forward"]["depth"] == M.MAX_DEPTH


def test_bylines_and_publications():
    rich = '<html><head><link rel="canonical" href="https://n.example/a/1"><meta property="og:site_name" content="The Letter"></head><body><p class="byline">By Ann Lee and Bo Ray</p><p>Ann Lee was here.</p></body></html>'
    got = M.parse_mail(mail("Issue 9", rich, sender="Team <hi@mail.letter.example>"))
    assert [a["name"] for a in got["authors"]] == ["Ann Lee", "Bo Ray"] and {a["confidence"] for a in got["authors"]} == {0.8}
    assert "By Ann" not in got["body_html"] and "Ann Lee was here." in got["body_html"] and got["original_url"] == "https://n.example/a/1"
    assert got["source"] == {"name": "The Letter", "url": "https://n.example", "sender_alias": "@mail.letter.example", "source": "newsletter-html", "confidence": 0.9}
    assert M.parse_mail(None)["subject"] is None and M.parse_mail(b"")["forwarded"] is False
    M.parse_mail(mail("Fwd: deep", "<div>" * 3000 + "<table>" * 500 + "x"))


def test_mails_in_batches(spark):
    rows = [(k, mail("Fwd: The Issue", PAGES[c])) for k, c in enumerate(sorted(PAGES))] + [(9, None)]
    got = D.parse_mails(spark.createDataFrame(rows, "i int, raw binary"), keep=("i",)).sort("i").collect()
    assert [r["forward"]["depth"] for r in got] == [1] * 5 + [0] and {r["forward_kind"] for r in got} == {"apple", "gmail", "outlook", "yahoo", "thunderbird", None}


T = "A paragraph of the article, with quite a few words in it, and a comma or two."


def test_an_article_split_over_siblings_comes_back_whole(spark):
    words = "A paragraph of this article goes on, and on, and says a few things more than that. "
    part = lambda k: f"<section><p>{k} {words * 3}</p><p>{words * 2}</p></section>"
    links = "".join(f"<li><a href=/{k}>A link to some other page of ours, number {k}</a></li>" for k in range(8))
    page = f"<body><nav>{links}</nav><div class=wrap>{part('One')}<ul>{links}</ul>{part('Two')}<p>Three {words}</p><div class=comments><p>Nice, {words}</p></div>{part('Four')}<script>var x</script></div></body>"
    text = " ".join(map(markup.read_text, markup.main_elements(page)))
    assert [text.count(k) for k in ("One", "Two", "Three", "Four", "Nice", "A link", "var x")] == [1, 1, 1, 1, 0, 0, 0]
    from corpusloom.functions.documents import extract_pages

    row = extract_pages(spark.createDataFrame([(1, "http://x.test/", page)], "page_id long, url string, html string")).first()
    assert "Four" in row["body_html"] and "script" not in row["body_html"] and "Nice" not in row["body_html"]
    assert markup.main_elements("<nav>x</nav>") == []


def test_main_part_of_a_page(spark):
    page = f'<body><div class="sidebar"><p>{T}</p><p>{T}</p></div><div id="wrap"><div class="entry"><p>{T}</p><p>{T}<script>x()</script></p><ul><li>One</li></ul><p onclick="y()">{T} <a href="javascript:z()">z</a></p></div><div class="comments"><p>{T}</p></div></div></body>'
    node = markup.main_element(page)
    assert node.attrs["class"] == "entry" and markup.read_text(node).count("A paragraph") == 3 and "One" in markup.read_text(node)
    got = D.extract_pages(spark.createDataFrame([(1, page, "https://x.example/"), (2, "<p>hi</p>", "u"), (3, None, None)], "page_id int, html string, url string")).sort("page_id").collect()
    assert got[0]["word_count"] == 53 and "script" not in got[0]["body_html"] and "onclick" not in got[0]["body_html"] and "javascript" not in got[0]["body_html"] and got[0]["body_html"].count("<p>") == 3
    assert got[1]["body_html"] is None and got[1]["text"] == "hi" and got[2]["text"] == ""
    sections = f"<body><main><section><p>{T}</p><p>{T}</p></section><section><p>{T}</p><p>{T}</p></section></main><nav><p>{T}</p></nav></body>"
    assert markup.main_element(sections).tag == "main" and markup.main_element("<nav>x</nav>") is None and markup.main_element("<div>" * 5000 + T) is not None
