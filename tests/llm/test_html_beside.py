"""Short regions beside an article stay, whatever their script and size; menus, notices and boxes don't."""

import pytest

from gridgauge.llm import html

LONG = "This is a long paragraph of the story that goes on and says many things about the world. " * 4
L = LONG.strip()
CHINESE = "这是一个很长的段落讲述了世界上的许多事情" * 8 + "。"
TWO = f"<div><p>{LONG}</p></div><div><p>{LONG}</p></div>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<body>{TWO}<div><p>Written by Ann</p></div>", [L, L, "Written by Ann"]),
        (f"<body><div><h2>Part one</h2></div>{TWO}", ["Part one", L, L]),
        (f"<body><section><p>{LONG}</p></section><section><p>{LONG}</p></section><section><h2>Z</h2><p>Tiny.</p></section>", [L, L, "Z", "Tiny."]),
        (f"<body>{TWO}<div><h2>Facts</h2><ul><li>alpha<li>beta</ul></div>", [L, L, "Facts", "alpha", "beta"]),
        (f"<body><div><h2>Facts</h2><ul><li>alpha<li>beta</ul></div><div><p>{LONG}</p></div>", ["Facts", "alpha", "beta", L]),
        (f"<body><div><pre>x = 1\ny = 2</pre></div><div><p>{LONG}</p></div>", ["x = 1 y = 2", L]),
        (f"<body><div>{CHINESE}</div><div>短い文。</div>", [CHINESE, "短い文。"]), (f"<body><div><p>{CHINESE}</p></div><div><p>短い文</p></div>", [CHINESE, "短い文"]),
        (f"<body><div><p>{LONG}</p><p><a href=x>Source one</a></p><p><a href=y>Source two</a></p></div>", [L, "Source one", "Source two"]),
        (f"<body><div><p>{LONG}</p></div><div>Copyright 2024 Foo Inc. All rights reserved.</div>", [L]),
        (f"<body><div><p>{LONG}</p></div><p>© 2024 Foo Inc.</p><ul><li><a href=x>Imprint</a><li><a href=y>Terms</a></ul>", [L]),
        (f"<body><div><p>{LONG}</p><p>The copyright of 1990 was about books.</p><p>All rights reserved seats are gone, he said.</p><p>End</p></div>", [L, "The copyright of 1990 was about books.", "All rights reserved seats are gone, he said.", "End"]),
        (f"<body><div><div><p>{LONG}</p></div></div><div><div><p>Nested short</p></div></div>", [L]),
        ("<div>Copyright 2024 Foo.</div>", ["Copyright 2024 Foo."]),
        (f"<body><div>Weather: 21</div><div>Home | About</div><div><p>{LONG}</p></div><div>Imprint</div><div class=comments><p>I liked it. Thanks.</p></div>", [L]),
    ],
)
def test_beside(page, want):
    assert html.main_text(page) == "\n\n".join(want)
