"""Made-up pages with known main text, on which the block classifier of ``html_extract`` is fitted.

Words of the main text start with k, all others with z; nothing else tells them apart but the page's
form: where a block stands, its element, its length, its links. ``FIT_PAGES`` pages bound the sample.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np

FIT_PAGES = 400
#: Innocent names that hold a word of page parts, and names of lists of comments.
MISLEADING = ["hidden-gem", "comment-on-law", "social-history", "menu-of-the-day", "search-for-truth", "cookie-recipe", "sharing-economy", "related-work", "notice-period", "footer-theorem", "ad-hoc"]
COMMENTS = ["comments", "comment-list", "commentlist", "replies", "disqus_thread", "user-comments"]
AROUND = ["menu", "sidebar", "site-header", "footer", "cookie-notice", "ad", "advert", "promo banner", "newsletter", "social share", "related", "breadcrumb", "widget", "masthead", "pagination"]


def _words(r: random.Random, initial: str, n: int) -> list[str]:
    return [initial + "".join(r.choice("aeioulmnrst") for _ in range(r.randint(1, 8))) for _ in range(n)]


def _line(r: random.Random, initial: str, n: int, stop: bool) -> str:
    words = _words(r, initial, n)
    for i in range(r.randint(5, 15), n - 1, 12):
        words[i] += "."
    return " ".join(words) + "." * stop


def _block(r: random.Random) -> str:
    """One or a few blocks of main text; now and then one with a misleading name."""
    made = _plain_block(r)
    if r.random() < 0.1 and made.startswith(("<p>", "<ul>", "<blockquote>")):
        made = re.sub(r"^<(\w+)>", rf'<\1 {r.choice(["class", "id"])}="{r.choice(MISLEADING)}">', made)
    return made


def _comments(r: random.Random) -> str:
    """A list of reader comments, as it stands below an article or in it."""
    lines = [_line(r, "z", r.choice([2, r.randint(4, 40)]), r.random() < 0.8) for _ in range(r.randint(1, 6))]
    outer, inner = r.choice([("ol", "li"), ("ul", "li"), ("div", "p"), ("section", "p")])
    items = "".join(f"<{inner}>{r.choice(['', '<p>']) if inner == 'li' else ''}{x}</{inner}>" for x in lines)
    return f'<{outer} {r.choice(["class", "id"])}="{r.choice(COMMENTS)}">{r.choice(["", "<h3>Zomments</h3>"])}{items}</{outer}>'


def _plain_block(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.5:
        text = _line(r, "k", r.randint(8, 90), r.random() < 0.95)
        if r.random() < 0.3:
            text += f' <a href="/x">{_line(r, "k", r.randint(1, 4), False)}</a> {_line(r, "k", r.randint(2, 12), True)}'
        return f"<p>{text}</p>"
    if kind < 0.54:
        return f"<p>{_line(r, 'k', r.randint(1, 12), True)} {r.choice(['All rights reserved.', '&copy; 2020', '&copy; All rights reserved.'])}</p>"
    if kind < 0.62:
        return f"<p>{_line(r, 'k', r.randint(1, 7), r.random() < 0.7)}</p>"
    if kind < 0.72:
        tag = r.choice(["h2", "h3"])
        return f"<{tag}>{_line(r, 'k', r.randint(1, 8), False)}</{tag}>"
    if kind < 0.86:
        items = "".join(f"<li>{_line(r, 'k', r.choice([1, 2, 3, r.randint(4, 25)]), r.random() < 0.4)}</li>" for _ in range(r.randint(2, 6)))
        return f"<ul>{items}</ul>"
    if kind < 0.9:
        return f"<blockquote>{_line(r, 'k', r.randint(6, 30), True)}</blockquote>"
    if kind < 0.95:
        cells = "".join(f"<tr><td>{_line(r, 'k', r.randint(1, 3), False)}<td>{_line(r, 'k', r.randint(1, 3), False)}</tr>" for _ in range(r.randint(2, 4)))
        return f"<table>{cells}</table>"
    return f'<p class="byline">{_line(r, "k", r.randint(2, 5), False)}</p>'


def _links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/z">{_line(r, "z", r.randint(1, 4), False)}</a></li>' for _ in range(n)) + "</ul>"


def _other(r: random.Random, inside: bool) -> str:
    """A block of anything else; ``inside`` the main text only what stands there."""
    text = f"<p>{_line(r, 'z', r.randint(2, 30), r.random() < 0.8)}</p>"
    named = f'<div class="{r.choice(AROUND)}">{r.choice([text, _links(r, r.randint(2, 6)), text[3:-4]])}</div>'
    if inside:
        return r.choice([_comments(r), named, f"<aside>{text}</aside>", f'<form>{text}<input><button>{_line(r, "z", 1, False)}</button></form>'])
    tag = r.choice(["nav", "header", "footer", "aside"])
    rights = f"{r.choice(['&copy; ', ''])}{_line(r, 'z', r.randint(1, 10), True)} {r.choice(['', 'All rights reserved.'])}"
    bare = r.choice([
        f"<div>{_links(r, r.randint(3, 8))}</div>", f'<p><a href="/z">{_line(r, "z", r.randint(1, 4), False)}</a> | <a href="/z">{_line(r, "z", 2, False)}</a></p>',
        f"<div>{_line(r, 'z', r.randint(1, 3), False)}</div>", f"<p>{rights}</p>", f"<footer>{rights}</footer>",
    ])
    return r.choice([f"<{tag}>{r.choice([text, _links(r, r.randint(2, 7))])}</{tag}>"] * 2 + [named] * 2 + [bare])


def pages(n: int = FIT_PAGES, seed: int = 17) -> list[str]:
    r = random.Random(seed)
    made = []
    for _ in range(n):
        start, end = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ('<div class="post-body">', "</div>"), ("<div>", "</div>"), ("<div>", "</div>"), ("", "")])
        title = f"<h1>{_line(r, 'k', r.randint(2, 9), r.random() < 0.2)}</h1>"
        body = [r.choice([title, title, f"<header>{title}</header>"]) if start in ("<article>", "<main>") else title]
        for _ in range(r.randint(1, 14)):
            body.append(_block(r))
            if r.random() < 0.08:
                body.append(_other(r, True))
        around = [[_other(r, False) for _ in range(r.randint(0, 3))] for _ in range(2)]
        if r.random() < 0.2:
            r.choice([body, around[1]]).append(_comments(r))
        if r.random() < 0.3:
            around[1].insert(0, f'<section class="comments"><p>{_line(r, "z", r.randint(4, 50), True)}</p><p>{_line(r, "z", r.randint(4, 20), True)}</p></section>')
        made.append(f"<html><head><title>z</title></head><body>{''.join(around[0])}{start}{''.join(body)}{end}{''.join(around[1])}</body></html>")
    return made


def is_content(text: str) -> bool:
    return text.lstrip("©&; ").lower().startswith("k")


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        move = np.linalg.solve(bend, slope)
        w += move
        if np.abs(move).max() < 1e-9:
            break
    return w


@lru_cache(maxsize=1)
def weights() -> tuple[float, ...]:
    """The classifier's weights, the same on every run."""
    from .html_extract import blocks_of, features

    found = [b for html in pages() for b in blocks_of(html)]
    x, y = np.array([features(*b) for b in found]), np.array([float(is_content(b[0])) for b in found])
    return tuple(float(round(v, 6)) for v in fit(x, y))
