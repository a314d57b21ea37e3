"""Rule data of the analyser: the one source for its Spark, Python and SQL forms."""

from __future__ import annotations

STOP_WORDS = frozenset(
    """
    a about above after again all also an and any are as at because been before below between both but by can could
    dare did do does during each few for from further had has have he her here his how i if in into is it its
    just me might may more most my need no nor not of off on once only or other ought our out over shall
    she should so some such than that the their them then there these they this those through to too under up used
    very was we were what when where which while who whom why will with would you your be
    """.split()
)

#: suffix>replacement, tried in this order where the rest has a vowel.
STEP2 = tuple(
    tuple(p.split(">"))
    for p in (
        "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize "
        "ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble logi>log ivity>ive ly>"
    ).split()
)
STEP3 = "al|ance|ence|er|able|ible|ment".split("|")
STEP4 = "ement|ment|ence|ance|able|ible|ant|ent|ion|ism|ate|iti|ous|ive|ize|ful".split("|")

SUFFIXES = frozenset(
    "." + s
    for s in (
        "bash c cfg conf cpp css csv fish go h hpp html ini java js json jsx kt less lua md perl php pl py r rb rs rst "
        "scala scss sh sql swift toml ts tsv tsx txt xml yaml yml zsh"
    ).split()
)
PRUNED = frozenset(".eggs .env .git .hg .idea .mypy_cache .pytest_cache .svn .tox .venv .vscode __pycache__ build dist env node_modules target vendor venv".split())
