"""The labelled table that trains the block classifier: small pages of common layouts.

Every page is put together from parts written here; a block is an article
block if it stands in the page's ``wanted`` texts. All words are our own.
"""

from __future__ import annotations

import itertools


def _words(n: int, start: int) -> str:
    """A sentence of ``n`` words that differs by ``start``."""
    base = "river stone garden window paper market winter signal harbor letter silver morning engine valley".split()
    return " ".join(base[(start * 5 + k * (start % 3 + 1)) % len(base)] for k in range(n)).capitalize() + f" {start}."


def _links(n: int, start: int) -> str:
    return "".join(f'<li><a href="/{start + k}">Topic {start + k}</a></li>' for k in range(n))


def labelled() -> list[tuple[str, set[str]]]:
    """(html, texts of its article blocks)."""
    out = []
    number = itertools.count(1)

    def part(n: int) -> str:
        return _words(n, next(number))

    lengths = ((45, 60, 30), (80, 4, 25, 2), (12, 18, 9), (150, 40), (3, 2, 5), (1, 70))
    for page, sizes in enumerate(lengths):
        for layout in range(4):
            title = part(6)
            body = [part(n) for n in sizes]
            linked, only_link = part(9), part(5)
            around = f"<div>{part(5)}</div><div><p>{part(28 + 30 * (page % 3))}</p></div>"
            inner = "".join(f"<p>{b}</p>" if k % 2 else f"<p><b>{b}<br><p>" for k, b in enumerate(body))
            inner += f'<p>{linked} <a href="/x">{part(4)}</a></p>'
            inner += f'<p><a href="/y">{only_link}</a></p><p>{body[0]}</p>'
            menu = f"<nav><ul>{_links(4 + page, page)}</ul></nav>"
            advert = f'<div class="ad">{part(8 + 9 * (page % 2))}</div>'
            side = f"<aside><h3>{part(2)}</h3><p>{part(14 + 8 * page)}</p><ul>{_links(3, 50)}</ul></aside>"
            note = f'<div id="cookie-notice"><p>{part(20)}</p><button>Accept</button></div>'
            talk = f'<section class="comments"><h2>{part(2)}</h2><p>{part(25)}</p><p>{part(6)}</p></section>'
            sign = f"<form><label>{part(3)}</label><input name=q><p>{part(11)}</p></form>"
            head = f"<header><h1>{part(3)}</h1><p>{part(7)}</p></header>"
            foot = f"<footer>{part(9)}<p>{part(24)}</p></footer>"
            if layout == 0:
                html = f"{menu}{around}{advert}<article><h1>{title}</h1>{inner}</article>{around}{foot}"
            elif layout == 1:
                html = f"{head}{menu}{note}<main><h2>{title}</h2>{inner}{talk}</main>{around}{side}{foot}"
            elif layout == 2:
                html = f"{head}{sign}{around}<article><header><h1>{title}</h1></header>{inner}{advert}{side}</article>{talk}{foot}"
            else:
                # No article element: long texts and their neighbours; a bar of links and lone lines around them.
                body = [part(40 + 11 * page), *body[1:], part(35 + 5 * page)]
                inner = "".join(f"<p>{b}</p>" for b in body)
                lone = f"<div>{part(3)}</div><div><a href='/'>{part(2)}</a></div>"
                bar = f"<div><a href='/1'>{part(2)}</a> <a href='/2'>{part(2)}</a> <a href='/3'>{part(1)}</a></div>"
                html = f"{bar}{lone}<div>{inner}</div>{bar}{lone}"
                out.append((f"<html><body>{html}</body></html>", set(body)))
                continue
            last = inner.partition(f"<p>{linked}")[2].partition("</a>")[0].replace(' <a href="/x">', "")
            out.append((f"<html><body>{html}</body></html>", {title, *body, f"{linked} {last}", only_link}))
    for n in (1, 2, 5, 12, 30, 90):
        text, other = part(n), part(2 * n)
        out.append((f"<p>{text}", {text}))
        out.append((f"<body><p>{text}</p><p>{other}</p></body>", {text, other}))
    return out
