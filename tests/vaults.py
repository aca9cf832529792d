"""Small vaults (file name -> text) and the embedder of the tests."""

import re
import sys
from pathlib import Path

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the tests


class Concepts:
    """An axis for each concept; a text scores on it by how many of the concept's patterns it matches."""

    def __init__(self, *concepts: str, width: int = 24):
        self.axes = [[re.compile(p, re.I) for p in c.split("|")] for c in concepts]
        self.width = width

    def encode(self, texts):
        found = [[sum(p.search(t) is not None for p in axis) for axis in self.axes] for t in texts]
        out = np.zeros((len(texts), self.width), np.float32)
        if self.axes:
            out[:, : len(self.axes)] = np.array(found, np.float32).reshape(len(texts), -1)
        return out


# The words zebra, striped horse, savannah and compiler are fixed: ranks below hang on them.
QUERY = {
    "by_word.md": "# Stripes at dusk\n\nThe zebra stood at the waterhole and drank.\n",
    "by_sense.md": "# Plains\n\nA striped horse crosses the savannah in the dry months.\n",
    "by_both.md": "# Both\n\nEvery zebra is a striped horse of the savannah.\n",
    "off_topic.md": "# Tools\n\nNotes on programming and how a compiler allocates registers.\n",
}
QUERY_CONCEPTS = ("zebra|striped horse|savannah", "compiler|programming")

EXPAND = {
    "A.md": "Alpha starts here. See [[B]] (cites), [[E]] (kind) and [[missing-thing]] (refers).\n",
    "B.md": "All about beta. Go on to [[C]] (refers).\n",
    "C.md": "The third note.\n",
    "D.md": "A note nobody links.\n",
    "E.md": "The fifth note.\n",
}
EXPAND_CONCEPTS = ("alpha", "beta")

NEIGHBORS = {
    "here.md": "[[there]] (cites) then [[yonder]] and [[far/away]] (refers)\n",
    "there.md": "a\n",
    "yonder.md": "b\n",
    "alone.md": "nothing\n",
}

INGEST = {
    "plain.md": "Just a line.\n",
    "dated.md": "---\ntitle: Long Note\ndomain: work\n---\nThe lead is [[crew/ann]] (lead).\n\n---\n\n## Timeline\n\n- first entry\n",
    "crew/ann.md": "Works with [[crew/bo]] (peer).\n",
}

# Two ways lead from the pools to the otters; one link dangles. The words intertidal, brackish, anemone and
# urchin each stand in one note.
SHORE = {
    "pools.md": "---\ntitle: Tide pools\ndomain: shore\n---\nIntertidal life waits for the flood.\n\nSome of it floats, see [[kelp]] (holds).\n\nSome of it grazes, see [[grazers]] (holds).\n",
    "kelp.md": "---\ntitle: Kelp\ndomain: shore\n---\nA forest under water.\n\nIt hides [[otters]] (shelters).\n\nIt breaks.\n",
    "grazers.md": "---\ntitle: Grazers\ndomain: shore\n---\nAn urchin eats what grows.\n\nIt is eaten by [[otters]] (feeds).\n\nIt hides.\n",
    "otters.md": "---\ntitle: Otters\ndomain: shore\n---\nThey come back each year.\n\nLast seen in [[storm-log]] (cites).\n\nMany.\n",
    "walks.md": "---\ntitle: Walks\ndomain: ways\n---\nThe anemone path is dry at noon.\n\nIt ends at [[pools]] (leads to).\n\nMore.\n",
    "marsh.md": "---\ntitle: Marsh\ndomain: ways\n---\nThe water is brackish.\n\nIt drains to [[pools]] (leads to).\n\nReeds.\n",
    "bakery.md": "---\ntitle: Bakery\ndomain: misc\n---\nBread rises.\n\nFlour is milled.\n\nSalt is mined.\n",
}
SHORE_CONCEPTS = ("intertidal", "brackish|estuary", "urchin")


def write(folder: Path, files: dict[str, str]) -> str:
    for name, text in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(folder)
