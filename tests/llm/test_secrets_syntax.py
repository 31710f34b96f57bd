"""Plain source and configuration syntax: the literal is reported and masked; lexing stays linear."""

import time

import pytest

from gridweave.llm import secrets

SECRET = "q7Zp2LxW9vTn4RbK8sYd"
SHAPES = [
    'cfg["client_secret"] = "{}"', "cfg['db']['client_secret'] = '{}'", 'client_secret = f"{}"', 'client_secret = b"{}"', 'client_secret = rb"{}"', 'client_secret = ("{}")', 'client_secret = ["{}"]',
    'client_secret = ["short", "{}"]', 'client_secret = (\n    "{}"\n)', '<add key="client_secret" value="{}"/>', "<add name='client_secret'\n  value='{}'/>", '{{"name": "client_secret", "value": "{}"}}',
    "<client_secret>{}</client_secret>", 'client_secret = os.getenv("X", "{}")', 'client_secret = os.environ.get("CLIENT_SECRET", "{}")', 'client_secret = Secret("{}")', 'client_secret = new Secret(("{}"))',
    'client_secret = "" + ("{}")', 'string client_secret = @"{}";', "$h{{client_secret}} = '{}'",
]


@pytest.mark.parametrize("shape", SHAPES)
def test_reported_and_masked(shape):
    text = "before\n" + shape.format(SECRET) + "\nafter"
    found = secrets.secrets_in(text)
    at = text.index(SECRET)
    assert any(s.kind == "literal" and (s.first, s.last) == (at, at + len(SECRET)) for s in found), found
    assert SECRET not in secrets.redact(text, found)


@pytest.mark.parametrize("text", [
    'client_secret = os.getenv("CLIENT_SECRET_NAME")', 'token = config.get("service_token_name1")', '<p>token</p> <b>secretive</b>', 'name: "secret", then: "value of it"', 'x = ["a", "b"]',
    'password = ("correct horse battery staple")', "the token (which expires) is: unknown", 'key="colour" value="q7Zp2LxW9vTn4RbK8sYd"',
])
def test_clean(text):
    assert not [s for s in secrets.secrets_in(text) if s.kind == "literal"]


GROWING = [
    "secret = (", "secret = [[[", 'secret = ["a",', "secret = f(", "secret=[a:1,", 'secret = (\n\n\n', "<secret>", "<secret>x</", 'key="secret" ', 'key="secret" value="', "secret = g(f(", 'secret = "a" "b" ', "secret = ((a, b), ",
    "cfg[secret] = [", "secret = x + (", '["secret"] = ',
]


@pytest.mark.parametrize("piece", GROWING)
def test_linear(piece):
    def took(n):
        text = piece * (n // len(piece))
        best = 1e9
        for _ in range(2):
            t = time.perf_counter()
            secrets.secrets_in(text)
            best = min(best, time.perf_counter() - t)
        return best

    small, large = took(50_000), took(400_000)
    assert large < 24 * small + 0.3, (small, large)
