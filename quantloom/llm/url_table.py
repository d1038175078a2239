"""A small labelled URL table, written for this repository: made of hand-chosen words, by a rule.

No row is taken from a crawl or from any table that is judged. Words of unwanted
sites and of ordinary ones meet a handful of host and path forms in turn; every
fifth row is held out from training, for tests.
"""

from __future__ import annotations

BLOCK_WORDS = """casino poker betting jackpot slots viagra cialis pills pharmacy-cheap replica watches-fake payday loans-fast crypto-doubler
forex-signals lottery winner-prize adult xxx cams singles-hot escort dating-hookup torrent warez keygen crack serial-key clickbait
ads-server pixel-track banner-ads popunder adclick link-farm backlinks seo-spam phishing verify-account login-update fake-invoice
weight-loss miracle-diet steroids free-spins bonus-win""".split()
ALLOW_WORDS = """library museum university school journal science history garden recipes weather council health sports travel music
films forum taxes bank books maps photos code status mail podcast theatre wiki news docs guide language grammar physics chemistry
biology geology archive gallery orchestra cycling hiking parks transport energy farming fishing carpentry knitting chess astronomy
bakery clinic bridge harbour railway""".split()
_TOPS = ("test", "example.com", "example.org", "invalid", "example.net")
_HOSTS = ("{w}.{t}", "www.{w}.{t}", "m.{w}.{t}", "{w}-{n}.{t}", "the-{w}.{t}")
_BLOCK_PATHS = ("/", "/buy/now", "/win?id={n}", "/en/{n}", "/go/{w}/offer", "/click/{n}", "/register/free")
_ALLOW_PATHS = ("/", "/about", "/articles/{n}", "/en/{n}", "/topics/{w}", "/2021/{n}.html", "/contact")


def rows() -> list[tuple[str, int]]:
    """(url, 1 block or 0 allow), both labels alternating."""
    out, n = [], max(len(BLOCK_WORDS), len(ALLOW_WORDS)) * 3
    for i in range(n):
        for label, words, paths in ((1, BLOCK_WORDS, _BLOCK_PATHS), (0, ALLOW_WORDS, _ALLOW_PATHS)):
            w, k = words[i % len(words)], i // len(words)
            host = _HOSTS[(i + 2 * k) % 5].format(w=w, t=_TOPS[(i + k) % 5], n=7 + i)
            out.append((f"https://{host}{paths[(i * 3 + k) % 7].format(w=w, n=11 + 13 * i % 900)}", label))
    return out


def split() -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    """Training and held-out rows. Held out are whole words: no form of one is trained on."""
    held_words = set(BLOCK_WORDS[::5]) | set(ALLOW_WORDS[::5])
    held = lambda url: any(f"{w}" in url.split("/")[2] for w in held_words)
    made = rows()
    return [r for r in made if not held(r[0])], [r for r in made if held(r[0])]
