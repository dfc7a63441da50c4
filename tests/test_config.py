import pytest
from msgspark.config import Config, alias_targets, include_patterns, parse_flag, upsert_section


def test_config():
    c = Config("en", ("en", "es"))
    assert c.targets == ("es",) and (c.batch_size, c.target_batch_tokens, c.retries, c.concurrency, c.mode) == (50, 2000, 2, 3, "keys")
    for bad in ({"mode": "inline"}, {"mode": "x"}, {"batch_size": 0}, {"retries": -1}, {"max_usd": 0}):
        with pytest.raises(ValueError):
            Config("en", ("es",), **bad)
    with pytest.raises(ValueError, match="locale"):
        Config("en", ("e/s",))


def test_flags():
    assert parse_flag(["--locale=es"], "locale") == "es" and parse_flag(["a", "--locale", "fr"], "locale") == "fr"
    assert parse_flag(["--locale", "--force"], "locale") is None and parse_flag([], "locale") is None


def test_sections():
    doc = "# A\n\n## X\nold\n### deep\nold\n## Y\nkeep\n"
    assert upsert_section(doc, "## X", "## X\nnew") == "# A\n\n## X\nnew\n\n## Y\nkeep\n"
    assert upsert_section("# A\n", "## X", "## X\nnew") == "# A\n\n## X\nnew\n" and upsert_section("", "## X", "## X\nnew") == "## X\nnew\n"
    once = upsert_section(doc, "## X", "## X\nnew")
    assert upsert_section(once, "## X", "## X\nnew") == once


def test_aliases_and_patterns():
    aliases = {"@/*": ["src/*", "lib/*"], "@/ui/*": ["ui/*"], "exact": ["e/index"]}
    assert alias_targets("@/ui/a", aliases) == ["ui/a", "src/ui/a", "lib/ui/a"] and alias_targets("exact", aliases) == ["e/index"] and alias_targets("react", aliases) == []
    assert include_patterns({"src/app", "app"}) == ["src/app/**/*.tsx"] and include_patterns(set()) == ["**/*.tsx", "**/*.jsx"]
