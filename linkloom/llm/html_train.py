"""Trains the block labeller of html_extract on made-up pages: python -m linkloom.llm.html_train.

A generator lays out pages with an article among menus, headers, footers, sidebars, notices, adverts,
forms and comments, with random words and the usual names of classes; what it put into the article is
the label. Some pages are cut off, some leave tags open.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from .html_extract import DIM, FIGURES, HIDDEN, PATHS, WORDS, blocks, features, label, _means, _sigmoid

SYLLABLES = "the an er in on re st th ed ha ti or en nd le de la que ion es con ra do ge ver be ung ch sch ie ou eau ai ment".split()
UI = ["Home", "About us", "Contact", "Log in", "Sign up", "Read more", "Share this", "Subscribe to our newsletter", "Accept all cookies", "Advertisement", "Sponsored", "Leave a comment", "Reply", "Related articles", "Privacy policy", "All rights reserved.", "Terms of use", "Search", "Follow us", "Menu", "We use cookies to improve your visit.", "Post comment", "Next", "Previous", "Tags"]
NAV = [("nav", ""), ("div", 'class="menu"'), ("ul", 'class="navbar"'), ("div", 'id="navigation"'), ("div", 'class="breadcrumbs"'), ("div", 'role="navigation"'), ("nav", 'class="main-nav"'), ("div", 'class="pagination"'), ("div", 'class="toc"')]
SIDE = [("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("section", 'class="related"'), ("div", 'class="widget"'), ("aside", 'class="recommended"'), ("div", 'class="share social"'), ("div", 'class="tags"'), ("div", 'class="promo"')]
NOTICE = [("div", 'class="cookie-notice"'), ("div", 'class="notice"'), ("div", 'class="alert"'), ("div", 'id="cookie-banner"'), ("div", 'role="alert"'), ("div", 'class="popup modal"'), ("div", 'class="newsletter subscribe"'), ("section", 'class="consent"'), ("div", 'class="paywall"'), ("p", 'class="notice"'), ("div", 'class="banner"')]
AD = [("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("div", 'id="ad-top"'), ("div", 'class="advertisement"'), ("aside", 'class="ad"'), ("div", 'class="sponsored"'), ("section", 'class="sponsor"'), ("p", 'class="ad"'), ("ins", 'class="adsbygoogle"')]
COMMENTS = [("section", 'class="comments"'), ("div", 'id="comments"'), ("div", 'class="comment-list"'), ("ol", 'class="commentlist"'), ("div", 'class="comment"'), ("article", 'class="comment"'), ("div", 'class="reader-comments"'), ("section", 'id="disqus"'), ("div", 'class="discussion replies"')]
MAIN = [("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="post"'), ("article", 'class="post entry"'), ("div", 'class="article-body"'), ("section", 'class="story"'), ("div", 'role="main"'), ("div", 'class="entry-content"')]
HEAD = [("header", ""), ("div", 'id="header"'), ("div", 'class="masthead"'), ("header", 'class="site-header"'), ("div", 'class="top-bar"'), ("div", 'class="header"')]
FOOT = [("footer", ""), ("div", 'id="footer"'), ("div", 'class="footer"'), ("footer", 'class="site-footer"'), ("div", 'class="copyright"')]

#: Tags that tell what stands in them without a class.
MEANING = frozenset(("nav", "aside", "article", "main", "header", "footer"))


class Page:
    def __init__(self, rng: random.Random):
        self.r, self.out, self.truth = rng, [], []

    def sentence(self, lo: int, hi: int) -> str:
        r = self.r
        words = ["".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        return (" ".join(words)).capitalize() + r.choice([".", ".", ".", "", "!"])

    def block(self, tag: str, text: str, main: bool, closed: bool = True) -> None:
        r = self.r
        if r.random() < 0.15:
            text = text.replace(" ", r.choice([" &amp; ", " <b>x</b> ", " <a href='/q'>y</a> ", "&nbsp;"]), 1)
        self.out.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if closed else ""))
        self.truth.append(main)

    def box(self, kinds: list, fill, inside: bool = False) -> None:
        tag, attributes = self.r.choice(kinds)
        if tag in MEANING and self.r.random() < 0.25:  # names that say nothing
            attributes = f'class="{"".join(self.r.choices(SYLLABLES, k=2))}"'
        if not inside and self.r.random() < 0.3:
            self.out.append("<div>")
        self.out.append(f"<{tag} {attributes}>".replace(" >", ">"))
        fill(tag)
        self.out.append(f"</{tag}>")

    def link_text(self) -> str:
        r, u = self.r, self.r.random()
        if u < 0.3:
            return r.choice(UI)
        if u < 0.65:  # plain words, in no form of a sentence
            return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) + r.choice(["", "", "", ","]) for _ in range(r.randint(1, 2)))
        return self.sentence(1, 3)

    def menu(self, _: str) -> None:
        r = self.r
        wrap, item = r.choice([("", "li"), ("ul", "li"), ("ul", "li"), ("ol", "li"), ("div", "div"), ("", "div"), ("table", "td"), ("dl", "dd"), ("", "p")])
        self.out.append(f"<{wrap}>" if wrap else "")
        for _ in range(r.randint(2, 9)):
            self.block(item, f"<a href='/x'>{self.link_text()}</a>" if r.random() < 0.95 else self.link_text(), False)
        self.out.append(f"</{wrap}>" if wrap else "")

    def noise(self, tag: str) -> None:
        r = self.r
        for _ in range(r.randint(1, 4)):
            text = r.choice(UI) if r.random() < 0.3 else self.sentence(2, 60 if r.random() < 0.4 else 15)
            if tag == "p" or r.random() < 0.35:
                self.out.append(text + ("" if tag == "p" else "<hr>"))
                self.truth.append(False)
                if tag == "p":
                    return
            else:
                kind = r.choice(["p", "p", "div", "li", "h3", "h1", "blockquote"])
                wrap = r.choice(["ul", "ol"]) if kind == "li" and r.random() < 0.7 else ""
                self.out.append(f"<{wrap}>" if wrap else "")
                self.block(kind, text if r.random() < 0.8 else f"<a href='/z'>{text}</a>", False)
                self.out.append(f"</{wrap}>" if wrap else "")

    def form(self, _: str) -> None:
        self.out.append("<form>")
        for _ in range(self.r.randint(1, 3)):
            self.block(self.r.choice(["p", "label", "div", "legend"]).replace("label", "div"), self.sentence(1, 6) + " <input type=text>", False)
        self.out.append("</form>")

    def article(self, _: str) -> None:
        r = self.r
        if r.random() < 0.85:
            self.block(r.choice(["h1", "h1", "h2"]), self.sentence(3, 12), True)
        for _ in range(r.randint(1, 14)):
            u = r.random()
            if u < 0.70:
                self.block("p", self.sentence(1, 90), True, closed=r.random() < 0.85)
            elif u < 0.76:
                self.block(r.choice(["h2", "h3"]), self.sentence(1, 8), True)
            elif u < 0.82:
                self.out.append("<ul>")
                for _ in range(r.randint(1, 4)):
                    self.block("li", self.sentence(1, 15), True)
                self.out.append("</ul>")
            elif u < 0.86:
                self.block(r.choice(["blockquote", "pre", "figcaption", "td", "dd"]), self.sentence(2, 30), True)
            elif u < 0.90:
                self.box(AD, self.noise, True)
            elif u < 0.93:
                self.box(SIDE + NOTICE, self.noise, True)
            elif u < 0.95:
                self.form("")
            elif u < 0.97:
                self.box(NAV, self.menu, True)
            else:
                self.out.append("<p><b>")
                self.out.append(self.sentence(5, 60) + "<br>")
                self.truth.append(True)
        if r.random() < 0.2:
            self.box(COMMENTS, self.noise, True)
        if r.random() < 0.12:
            self.box(FOOT[:1], self.noise, True)


def page(rng: random.Random) -> tuple[str, list[bool]]:
    p = Page(rng)
    p.out.append("<!DOCTYPE html><html><head><title>x</title><script>var a='</p>';</script></head><body>")
    if rng.random() < 0.5:
        p.box(HEAD, lambda t: (p.block("div", p.sentence(1, 6), False), p.menu(t)) if rng.random() < 0.5 else p.block(rng.choice(["h1", "p"]), p.sentence(1, 9), False))
    first = [(NAV, p.menu, 0.8), (NOTICE, p.noise, 0.3), (AD, p.noise, 0.5), (SIDE, p.noise, 0.25), ([("div", 'class="search"')], p.form, 0.15)]
    last = [(COMMENTS, p.noise, 0.35), (SIDE, p.noise, 0.4), (AD, p.noise, 0.3), (NOTICE, p.noise, 0.2), (NAV, p.menu, 0.2), ([("div", 'class="contact"')], p.form, 0.2)]
    rng.shuffle(first), rng.shuffle(last)
    for kinds, fill, share in first:
        if rng.random() < share:
            p.box(kinds, fill)
    wrapped = rng.random() < 0.3
    if wrapped:
        p.out.append(rng.choice(["<main>", "<div class='wrapper'>", "<div id='page' class='container'>"]))
    p.box(MAIN, p.article, True)
    if wrapped and rng.random() < 0.5:
        p.out.append("</main></div>")
    for kinds, fill, share in last:
        if rng.random() < share:
            p.box(kinds, fill)
    if rng.random() < 0.85:
        p.box(FOOT, p.noise)
    return "".join(p.out) + "</body></html>", p.truth


def examples(n: int, seed: int) -> list[tuple[list, np.ndarray]]:
    rng, out = random.Random(seed), []
    while len(out) < n:
        html, truth = page(rng)
        cut = blocks(html)
        if len(cut) == len(truth):
            keep = rng.randint(len(cut) // 2, len(cut)) if rng.random() < 0.1 else len(cut)
            if keep:
                out.append((cut[:keep], np.array(truth[:keep], bool)))
    return out


def _steps(x, mask, w, b):
    """Forward pass that keeps what the backward pass needs."""
    h, c, kept, d = np.zeros((x.shape[1], HIDDEN)), np.zeros((x.shape[1], HIDDEN)), [], x.shape[2]
    out = np.empty((*x.shape[:2], HIDDEN))
    for t in range(len(x)):
        z = x[t] @ w[:d] + h @ w[d:] + b
        s, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        new = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * g
        kept.append((h, c, s, g, np.tanh(new), m))
        c, h = np.where(m, new, c), np.where(m, s[:, 2 * HIDDEN :] * np.tanh(new), h)
        out[t] = h
    return out, kept


def _back(dout, x, kept, w):
    dw, db, dx, d = np.zeros_like(w), np.zeros(4 * HIDDEN), np.zeros_like(x), x.shape[2]
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(x) - 1, -1, -1):
        h, c, s, g, tc, m = kept[t]
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        dh = dh + dout[t]
        dn = np.where(m, dc + dh * o * (1 - tc**2), 0)
        dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), np.where(m, dh * tc, 0) * o * (1 - o), dn * i * (1 - g**2)], axis=1)
        dw[:d] += x[t].T @ dz
        dw[d:] += h.T @ dz
        db += dz.sum(0)
        dx[t] = dz @ w[:d].T
        dh, dc = np.where(m, 0, dh) + dz @ w[d:].T, np.where(m, dn * f, dc)
    return dw, db, dx


def train(pages: int = 8000, epochs: int = 6, blind: float = 0.4, seed: int = 10, batch: int = 50) -> dict[str, np.ndarray]:
    """blind: share of the pages that show no words in a pass, so that the labels do not hang on the generator's."""
    rng = np.random.default_rng(seed)
    d = 2 * DIM + FIGURES
    m = {"path": rng.normal(0, 0.3, (PATHS, DIM)), "word": rng.normal(0, 0.1, (WORDS, DIM)), "v": rng.normal(0, 0.2, 2 * HIDDEN), "v0": np.zeros(())}
    for k in "fb":
        m[f"w{k}"], m[f"b{k}"] = rng.normal(0, 0.15, (d + HIDDEN, 4 * HIDDEN)), np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    one, two, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    data = examples(pages, seed)
    for epoch in range(epochs):
        loss = 0.0
        for chosen in np.array_split(rng.permutation(len(data)), len(data) // batch):
            some = [data[j] for j in chosen]
            f = [features(p) for p, _ in some]
            n = max(len(p) for p, _ in some)
            x, y, mask = np.zeros((n, len(some), d)), np.zeros((n, len(some))), np.zeros((n, len(some)), bool)
            for c, ((p, truth), (a, b, g)) in enumerate(zip(some, f, strict=True)):
                x[: len(p), c] = np.concatenate([_means(a, m["path"]), _means(b, m["word"]), np.array(g)], axis=1)
                y[: len(p), c], mask[: len(p), c] = truth, True
            sees = rng.random(len(some)) >= blind
            x[:, ~sees, DIM : 2 * DIM] = 0
            hf, kf = _steps(x, mask, m["wf"], m["bf"])
            hb, kb = _steps(x[::-1], mask[::-1], m["wb"], m["bb"])
            both = np.concatenate([hf, hb[::-1]], axis=2)
            prob = _sigmoid(both @ m["v"] + m["v0"])
            loss -= np.log(np.where(y > 0, prob, 1 - prob)[mask] + 1e-9).mean()
            dl = np.where(mask, prob - y, 0) / mask.sum()
            grad = {"v": np.einsum("tb,tbh->h", dl, both), "v0": dl.sum()}
            db = dl[:, :, None] * m["v"]
            grad["wf"], grad["bf"], dxf = _back(db[:, :, :HIDDEN], x, kf, m["wf"])
            grad["wb"], grad["bb"], dxb = _back(db[::-1, :, HIDDEN:], x[::-1], kb, m["wb"])
            dx = dxf + dxb[::-1]
            grad["path"], grad["word"] = np.zeros_like(m["path"]), np.zeros_like(m["word"])
            for c, (a, b, _) in enumerate(f):
                for t, (pa_, wo) in enumerate(zip(a, b, strict=True)):
                    np.add.at(grad["path"], list(pa_), dx[t, c, :DIM] / len(pa_))
                    if sees[c]:
                        np.add.at(grad["word"], wo, dx[t, c, DIM : 2 * DIM] / len(wo))
            step += 1
            rate = 0.01 * (0.5 ** (epoch / 2))
            for k in m:
                one[k] = 0.9 * one[k] + 0.1 * grad[k]
                two[k] = 0.999 * two[k] + 0.001 * grad[k] ** 2
                m[k] = m[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {loss / (len(data) // batch):.4f}", flush=True)
    return {k: v.astype(np.float32) for k, v in m.items()}


if __name__ == "__main__":
    model = train()
    held = examples(500, 77)
    right = [np.mean(g == t) for g, (_, t) in zip(label([p for p, _ in held], model), held, strict=True)]
    print(f"held out: {np.mean(right):.4f} of blocks, {np.mean(np.array(right) == 1):.4f} of pages all right")
    np.savez_compressed(Path(__file__).with_name("html_model.npz"), **model)
