"""A small collection of notes used by the tests."""

from tesserae.operators.parse import build_tables
from tesserae.plans.catalog import Catalog

NOTES = {
    "Start.md": "---\ntitle: Start\nstatus: active\ntags: [hub, area/home]\n---\n# Start\nTo [[Work/Plan]] and [[Recipe|food]], ![[Plan]] and ![[logo.png]] and [[Recipe#Steps]].\n> [!Tip]+ Hint\n> more\n==marked== #inbox #area/home\n",
    "Work/Plan.md": "---\ntitle: Plan\nstatus: active\nrating: 5\ntags:\n  - work/deep\ndue: 2026-03-01\n---\n- [ ] write 2026-02-03\n- [x] read\n  - [-] drop\nSee [[Start]]. The end ^last\nrating:: 9\n",
    "Work/Old.md": "---\ntitle: Old\nstatus: done\nrating: \"7\"\n---\n* [X] closed [[Start]] #work\ntext (score:: 3)\nmood:: calm (none:: 1)\n",
    "Food/Recipe.md": "---\ntitle: Recipe\nrating: 0\nflag: true\n---\nText `#no [[no]]` and\n```\n#no\n- [x] in code\n```\n[site](https://x.y) [gone](../Work/None.md) [ok](../Start.md#top) [bad](..\\Start.md)\n",
    "Food/Plan.md": "no frontmatter, [[Missing]] #Food\n",
    "Daily/2026-01-01.md": "---\n---\n[[Food/Plan]] [[Plan]]\nstatus:: quiet\nstatus:: loud\n",
}


def frame(spark, notes=NOTES):
    rows = [(p, len(t), 1_700_000_000_000 + i, 1_600_000_000_000 + i, t) for i, (p, t) in enumerate(notes.items())]
    return spark.createDataFrame(rows, "path string, size bigint, mtime bigint, ctime bigint, content string")


def catalog(spark, notes=NOTES):
    return Catalog(**{n: df.cache() for n, df in build_tables(frame(spark, notes)).items()})
