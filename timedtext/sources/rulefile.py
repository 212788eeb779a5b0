"""Editing rule files in place: what is not a rule keeps its text and its order."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field

_ITEM = re.compile(r'<item\s+enabled="([^"]*)"\s*>t=(.*?)</item>')


@dataclass
class Rule:
    pattern: str
    enabled: bool = True
    rest: dict = field(default_factory=dict)


class RuleFile:
    """The rules of one file (xml, json or txt). A change that cannot be written is taken back."""

    def __init__(self, path: str):
        self.path, self.kind = path, path.rsplit(".", 1)[-1].lower()
        if self.kind not in ("xml", "json", "txt"):
            raise ValueError(f"no rule file: {path}")
        with open(path, encoding="utf-8-sig", newline="") as f:
            self.parts = self._read(f.read())

    def _read(self, body: str) -> list:
        """Rules, and between them the raw lines or values that are none."""
        if self.kind == "json":
            return [Rule(x["filter"], bool(x.get("opened")), x) if isinstance(x, dict) and x.get("type") == 0 and x.get("filter") else x for x in json.loads(body or "[]")]
        lines = body.splitlines()
        if self.kind == "txt":
            return [Rule(x.strip()) for x in lines if x.strip()]
        return [Rule(m[2], m[1] == "true") if (m := _ITEM.search(x)) else x for x in lines]

    @property
    def rules(self) -> list[Rule]:
        return [x for x in self.parts if isinstance(x, Rule)]

    def text(self) -> str:
        if self.kind == "json":
            return json.dumps([{**x.rest, "type": 0, "filter": x.pattern, "opened": x.enabled} if isinstance(x, Rule) else x for x in self.parts], ensure_ascii=False) + "\n"
        line = (lambda r: r.pattern) if self.kind == "txt" else (lambda r: f'<item enabled="{str(r.enabled).lower()}">t={r.pattern}</item>')
        out = [line(x) if isinstance(x, Rule) else x for x in self.parts]
        return "\n".join(out) + "\n" if out else ""

    def _write(self, parts: list) -> None:
        before, self.parts = self.parts, parts
        try:
            spare = f"{self.path}.new"
            with open(spare, "w", encoding="utf-8", newline="") as f:
                f.write(self.text())
            os.replace(spare, self.path)
        except OSError:
            self.parts = before
            raise

    def _at(self, k: int) -> int:
        return [i for i, x in enumerate(self.parts) if isinstance(x, Rule)][k]

    def add(self, pattern: str) -> bool:
        """False for a blank pattern or one that is there; a disabled one comes back on."""
        pattern = pattern.strip()
        same = next((i for i, r in enumerate(self.rules) if r.pattern == pattern), None)
        if not pattern or (same is not None and self.rules[same].enabled):
            return False
        if same is not None:
            self.toggle(same)
            return True
        end = next((i for i, x in enumerate(self.parts) if isinstance(x, str) and "</filters>" in x), len(self.parts))
        self._write([*self.parts[:end], Rule(pattern), *self.parts[end:]])
        return True

    def toggle(self, k: int) -> None:
        if self.kind == "txt":
            raise ValueError("a text file has no disabled rules")
        self._replace(k, lambda r: Rule(r.pattern, not r.enabled, r.rest))

    def edit(self, k: int, pattern: str) -> None:
        self._replace(k, lambda r: Rule(pattern.strip(), r.enabled, r.rest))

    def _replace(self, k: int, change) -> None:
        i = self._at(k)
        self._write([*self.parts[:i], change(self.parts[i]), *self.parts[i + 1 :]])

    def delete(self, k: int) -> None:
        i = self._at(k)
        self._write(self.parts[:i] + self.parts[i + 1 :])
