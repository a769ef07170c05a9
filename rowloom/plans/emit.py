"""A recipe as a PySpark script that runs it with this package."""

from __future__ import annotations

import json

from rowloom.plans.recipe import Recipe, Step, redact, unexportable, unresolved_templates
from rowloom.plans.steps import BROWSER_STEPS


def _plain(step: Step) -> dict:
    nested = {b: [_plain(s) for s in getattr(step, b)] for b in ("children", "ifBranch", "elseBranch") if getattr(step, b) is not None}
    return {"id": step.id, "type": step.type, "label": step.label, "config": step.config, **nested}


def emit_script(recipe: Recipe) -> tuple[str, list[str]]:
    """The script, with secrets read from the environment, and warnings about what it will not do as the recipe says."""
    clean, secrets = redact(recipe)
    warnings = [f"{kind} ({i}): {why}" for i, kind, why in unexportable(clean)]
    warnings += [f"{t['type']} ({t['stepId']}): {t['template']} in {t['where']} is resolved when it runs" for t in unresolved_templates(clean)]
    if any(s["type"] in BROWSER_STEPS for s in secrets):
        warnings.append("steps with secrets act on a live browser and are refused")
    body = json.dumps({"name": clean.name, "version": clean.version, "targetOrigin": clean.target_origin, "steps": [_plain(s) for s in clean.steps]}, ensure_ascii=False, indent=2)
    lines = [
        '"""' + clean.name.replace('"', "'") + ': runs a recipe over a table of pages."""', "", "import json", "import os", "import sys", "",
        "from rowloom.plans.compiler import Sources, compile_recipe", "from rowloom.session import local_session, ship_package", "from rowloom.sinks.render import write_lines", "",
        f"RECIPE = json.loads({body!r})", "", f"SECRETS = {[s['env'] for s in secrets]!r}", "", "",
        "def main(pages: str, out: str) -> None:", "    text = json.dumps(RECIPE)", "    for name in SECRETS:", '        text = text.replace(f"__ENV__{name}__", json.dumps(os.environ[name])[1:-1])',
        "    spark = local_session()", "    ship_package(spark)", "    done = compile_recipe(spark, text, Sources(pages=spark.read.parquet(pages)))",
        '    formats = [e["format"] for e in done.exports] or ["jsonl"]', "    for fmt in formats:", '        write_lines(done.rows, fmt, f"{out}/{fmt}", "overwrite")', "", "",
        'if __name__ == "__main__":', "    main(*sys.argv[1:3])", "",
    ]
    return "\n".join(lines), warnings
