from __future__ import annotations

import pytest

from trolley.llm import html_text as H


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<head><title>t</title><body><article><p>own text</p></article>", "own text"),
        ("<head><meta charset=x><title>t <b>u</title><link rel=a><article><p>own text</p></article>", "own text"),
        ("<head><title>t<body><article><p>own text</p></article>", "own text"),
        ("<HEAD><script>a</script></HEAD><article><p>own text</p></article>", "own text"),
        ("<article><p>one <svg class=i /> two</p><p>three</p></article>", "one two three"),
        ("<article><p>one <svg class=i/>two</p><svg><text>x</text></svg><p>three</p></article>", "one two three"),
        ("<article><p>one <svg><g><svg><a>x</a></svg><path/>y</g></svg> two</p></article>", "one two"),
        ("<article><p>one <svg class=i> two</p><p>three</p></article>", "one two three"),
        ("<article><p>one <svg class=i></p><p>two</p><svg>x</svg><p>three</p></article>", "one two three"),
        ("<article><p>so <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds</p></article>", "so a=1 holds"),
        ("<article><p>one <math /> two</p></article>", "one two"),
        ("<article><noscript><p>one</p></noscript><p>two <object data=x>three</object></p></article>", "one two three"),
        ("<article><p>one<canvas id=c>two</canvas></p></article>", "onetwo"),
        ("<article><p>one <iframe src=x /> two <iframe src=y> three</p></article>", "one two three"),
        ("<article><template><p>x</p><template>y</template>z</template><p>one</p></article>", "one"),
        ("<article><script src=x /><p>one</p><style>p{}</style><script>var a='</p>'</script></article>", "one"),
        ("<article><p>one</p><script>two", "one"),
    ],
)
def test_elements(page, wanted):
    assert " ".join(b.text for b in H.blocks(page)) == wanted
    assert " ".join(b.text for b in H.article(page, H.trained())) == wanted
