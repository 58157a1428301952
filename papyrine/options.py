"""Conversion options: defaults, profile presets, layered loading and validation."""

from __future__ import annotations

import dataclasses
import json
import os
import re
import tomllib
from dataclasses import dataclass, field
from typing import Any

PROFILES = ("commonmark", "gfm", "extended", "pandoc", "obsidian", "mdx-safe", "plain-text")
EXTENDED = ("extended", "pandoc", "obsidian", "mdx-safe")

#: Allowed words of each choice; the first is the default.
CHOICES = {
    "profile": PROFILES,
    "heading_style": ("atx", "setext"),
    "bullet_marker": ("hyphen", "asterisk", "plus"),
    "code_fence": ("backticks", "tildes"),
    "hard_break_style": ("two-spaces", "backslash"),
    "hr_style": ("dashes", "asterisks", "underscores"),
    "unicode_normalization": ("off", "nfc", "nfkc"),
    "trailing_whitespace": ("trim", "preserve"),
    "final_newline": ("ensure", "preserve", "suppress"),
    "link_style": ("inline", "reference", "collapsed-reference", "shortcut-reference"),
    "reference_placement": ("end", "section-end", "adjacent"),
    "title_attribute": ("ignore", "inline", "reference"),
    "hidden_content_policy": ("hide", "show"),
    "responsive_image_policy": ("first-srcset", "largest", "preserve-srcset"),
    "image_mode": ("inline", "reference", "skip", "alt-text"),
    "media_policy": ("inline", "link", "placeholder", "drop"),
    "form_handling": ("drop", "readable"),
    "details_handling": ("expand", "summary-only", "drop"),
    "custom_element_policy": ("unwrap", "drop", "preserve-html"),
    "table_handling": ("gfm", "html-fallback", "flatten", "csv-like", "drop"),
    "difficult_table_strategy": ("flatten", "html-fallback", "span-cells"),
    "math_output": ("preserve-html", "inline-dollar", "block-dollar", "fenced", "plain"),
    "mermaid": ("fenced", "preserve-html", "drop"),
}
#: Metadata fields, by the names that settings have for them.
METADATA = {
    "title": "title", "description": "description", "canonical_url": "canonical_url", "open_graph_title": "og_title", "open_graph_description": "og_description",
    "open_graph_image": "og_image", "twitter_title": "twitter_title", "twitter_description": "twitter_description",
}
ACTIONS = ("drop", "unwrap", "text", "html", "markdown-template", "fenced", "link", "image")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Options:
    """All settings of a conversion; keys may be written in kebab case and grouped in tables when loaded."""

    profile: str = "commonmark"
    strict: bool = False
    heading_style: str = "atx"
    bullet_marker: str = "hyphen"
    code_fence: str = "backticks"
    hard_break_style: str = "two-spaces"
    hr_style: str = "dashes"
    unicode_normalization: str = "off"
    trailing_whitespace: str = "trim"
    final_newline: str = "ensure"
    link_style: str = "inline"
    reference_placement: str = "end"
    title_attribute: str = "ignore"
    normalize_whitespace: bool = False
    remove_selectors: tuple[str, ...] = ()
    unwrap_selectors: tuple[str, ...] = ()
    keep_only_selectors: tuple[str, ...] = ()
    extract_selector: str | None = None
    main_content_selector: str | None = None
    remove_tags: tuple[str, ...] = ("head", "script", "style", "noscript", "template", "iframe", "svg", "canvas")
    per_tag_behavior: tuple[tuple[str, str], ...] = ()
    hidden_content_policy: str = "hide"
    base_url: str | None = None
    url_rewrite_rules: tuple[tuple[str, str], ...] = ()
    remove_tracking_params: bool = True
    tracking_params: tuple[str, ...] = ()
    allowed_url_schemes: tuple[str, ...] = ()
    blocked_url_schemes: tuple[str, ...] = ("javascript", "data", "file")
    lazy_image_attrs: tuple[str, ...] = ("data-src", "data-original")
    responsive_image_policy: str = "first-srcset"
    preserve_image_metadata: bool = False
    image_mode: str = "inline"
    media_policy: str = "inline"
    form_handling: str = "drop"
    details_handling: str = "expand"
    custom_element_policy: str = "unwrap"
    heading_offset: int = 0
    task_lists: bool = True
    table_handling: str = "gfm"
    difficult_table_strategy: str = "flatten"
    code_language_patterns: tuple[str, ...] = (r"language-([\w+#-]+)", r"lang-([\w+#-]+)", r"highlight-([\w+#-]+)")
    detect_languages: bool = True
    definition_lists: bool = False
    footnotes: bool = False
    math_enabled: bool = False
    math_output: str = "preserve-html"
    mermaid: str = "fenced"
    #: (selectors, action, template, priority)
    custom_rules: tuple[tuple[tuple[str, ...], str, str, int], ...] = ()
    max_input_bytes: int = 0
    max_output_bytes: int = 0
    max_dom_depth: int = 256
    max_node_count: int = 0
    max_attribute_len: int = 0
    #: Metadata fields that a result has, and frontmatter with it; None: all.
    metadata: tuple[str, ...] | None = None
    explicit: frozenset[str] = field(default=frozenset(), compare=False)

    @classmethod
    def of(cls, profile: str = "commonmark", **given: Any) -> Options:
        """Options of a profile; what is given outright wins over the profile's own defaults."""
        return cls(profile=profile, **given, explicit=frozenset(given)).resolved()

    def resolved(self) -> Options:
        more: dict[str, Any] = {}
        if self.profile in EXTENDED:
            more = {"math_enabled": True, "math_output": "inline-dollar", "footnotes": True, "definition_lists": True}
        elif self.profile == "plain-text":
            more = {"image_mode": "alt-text"}
        out = dataclasses.replace(self, **{k: v for k, v in more.items() if k not in self.explicit})
        out.validate()
        return out

    def validate(self) -> None:
        from papyrine.html.select import SelectorError, compile_selector

        for name, words in CHOICES.items():
            if getattr(self, name) not in words:
                raise ConfigError(f"{name}: {getattr(self, name)!r} is none of {', '.join(words)}")
        chosen = [*self.remove_selectors, *self.unwrap_selectors, *self.keep_only_selectors, *(s for r in self.custom_rules for s in r[0])]
        for css in [*chosen, *filter(None, (self.extract_selector, self.main_content_selector))]:
            try:
                compile_selector(css)
            except SelectorError as e:
                if self.strict:
                    raise ConfigError(f"selector {css!r}") from e
        for pattern in [*(p for p, _ in self.url_rewrite_rules), *self.code_language_patterns]:
            try:
                re.compile(pattern)
            except re.error as e:
                raise ConfigError(f"pattern {pattern!r}: {e}") from e
        if self.base_url is not None and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", self.base_url):
            raise ConfigError(f"base_url {self.base_url!r} isn't absolute")
        for name in self.metadata or ():
            if name not in METADATA.values():
                raise ConfigError(f"metadata field {name!r}")
        for rule in self.custom_rules:
            if rule[1] not in ACTIONS:
                raise ConfigError(f"rule action {rule[1]!r}")


def _flat(data: dict[str, Any], out: dict[str, Any]) -> dict[str, Any]:
    """Kebab keys in nested tables to field names; unknown keys are ignored."""
    names = {f.name for f in dataclasses.fields(Options)}
    for key, v in data.items():
        name = {"bullet": "bullet_marker", "br_style": "hard_break_style", "skip_tags": "remove_tags"}.get(key.replace("-", "_"), key.replace("-", "_"))
        if name == "math" and isinstance(v, dict):
            out |= {f"math_{k.replace('-', '_')}": x for k, x in v.items() if f"math_{k}" in names}
        elif name == "metadata" and isinstance(v, dict):
            out[name] = tuple(field for k, field in METADATA.items() if v.get(k) or v.get(k.replace("_", "-")))
        elif name == "per_tag_behavior" and isinstance(v, dict):
            out[name] = tuple(v.items())
        elif name == "url_rewrite_rules":
            out[name] = tuple((r["pattern"], r["replacement"]) if isinstance(r, dict) else tuple(r) for r in v)
        elif name == "custom_rules":
            out[name] = tuple((tuple(r.get("selectors", ())), r["action"], r.get("template") or "", int(r.get("priority", 0))) if isinstance(r, dict) else r for r in v)
        elif isinstance(v, dict):
            _flat(v, out)
        elif name in names:
            out[name] = tuple(v) if isinstance(v, list) else v
    return out


def discover(home: str | None = None, here: str = ".") -> list[str]:
    """Configuration files that are there, the weakest first: the user's (in the configuration folder), the project's."""
    home = home or os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return [p for p in (os.path.join(home, "papyrine", "config.toml"), os.path.join(here, ".papyrine.toml")) if os.path.isfile(p)]


def show(o: Options | None = None, form: str = "json") -> str:
    """Options (the defaults without any) as JSON or TOML that load_options reads."""
    data = dataclasses.asdict(o or Options())
    data.pop("explicit")
    data["custom_rules"] = [{"selectors": r[0], "action": r[1], "template": r[2], "priority": r[3]} for r in data["custom_rules"]]
    data["per_tag_behavior"] = dict(data["per_tag_behavior"])
    if form == "json":
        return json.dumps(data, indent=2)
    # What isn't set has no line in TOML; tables come after plain values.
    plain = {k: v for k, v in data.items() if v is not None and not isinstance(v, dict)}
    lines = [f"{k.replace('_', '-')} = {_toml(v)}" for k, v in plain.items()]
    for k, v in data.items():
        if isinstance(v, dict) and v:
            lines += ["", f"[{k.replace('_', '-')}]", *(f"{json.dumps(x)} = {_toml(y)}" for x, y in v.items())]
    return "\n".join(lines) + "\n"


def _toml(v: Any) -> str:
    if isinstance(v, (list, tuple)):
        return f"[{', '.join(map(_toml, v))}]"
    if isinstance(v, dict):
        return "{ " + ", ".join(f"{k} = {_toml(x)}" for k, x in v.items()) + " }"
    # JSON's strings, numbers and booleans are TOML's too.
    return json.dumps(v)


def load_options(*files: str, env: dict[str, str] | None = None, **flags: Any) -> Options:
    """Layers, the later the stronger: TOML or JSON files, PAPYRINE_* variables (``__`` nests), keyword arguments."""
    data: dict[str, Any] = {}
    for path in files:
        with open(path, "rb") as f:
            data = _flat(json.load(f) if path.endswith(".json") else tomllib.load(f), data)
    for k, v in sorted((os.environ if env is None else env).items()):
        if k.startswith("PAPYRINE_"):
            try:
                v = json.loads(v)
            except ValueError:
                pass
            data = _flat({k[9:].split("__")[-1].lower(): v}, data)
    data |= {k: v for k, v in flags.items() if v is not None}
    return Options.of(data.pop("profile", "commonmark"), **data)
