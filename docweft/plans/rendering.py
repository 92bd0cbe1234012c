"""Readable plans: the operation log as indented JSON, moments as ISODate("...")."""

from __future__ import annotations

import json
import re


def render(stages: list[dict]) -> str:
    text = json.dumps(stages, indent=2, ensure_ascii=False)
    return re.sub(r'\{\s*"\$date":\s*("(?:[^"\\]|\\.)*")\s*\}', r"ISODate(\1)", text)
