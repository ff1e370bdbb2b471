"""Rooms of files and conversations by keywords, and drawer ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memspark.functions.text import as_column, best_scored, bound, contained, stem, strings
from memspark.functions.wordlists import ROOM_FOLDERS, TOPICS


def convo_room(text: Column | str, topics: dict = TOPICS, head: int = 3000) -> Column:
    """The topic with the most of its words in the first characters; the first of equals; ``general`` without any."""
    lowered = F.lower(F.substring(as_column(text), 1, head))
    return bound(lowered, lambda t: best_scored([(name, contained(t, words)) for name, words in topics.items()], "general"))


def project_room(rel_path: Column | str, text: Column | str, rooms: tuple = (), folders: dict = ROOM_FOLDERS, head: int = 2000) -> Column:
    """The room of a project file. In order: a folder of the path that is a folder name; a folder name in the file's stem; a
    custom room whose name or keyword is in the stem; the best score of words in the first characters, where a custom
    room gets one for each of its words and a folder's room one for each folder name, the first room of equals that has
    any; ``general``. rooms: (name, keywords) pairs."""
    path = F.lower(as_column(rel_path))
    name = stem(path)
    pairs = [(word, room) for room, words in folders.items() for word in words]
    room_of = F.create_map(*(F.lit(x) for pair in pairs for x in pair))
    segments = F.split(path, "/")
    known = F.transform(F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0))), lambda s: room_of[s])
    by_folder = F.get(F.filter(known, lambda r: r.isNotNull()), F.lit(0))
    in_stem = F.filter(strings([w for w, _ in pairs]), lambda w: F.contains(name, w))
    by_stem = room_of[F.get(in_stem, F.lit(0))]
    custom = [(room, tuple(dict.fromkeys(x.lower() for x in (room, *words)))) for room, words in rooms]
    by_custom = F.coalesce(F.lit(None).cast("string"), *(F.when(contained(name, words) > 0, F.lit(room)) for room, words in custom))

    def by_words(lowered: Column) -> Column:
        scores: dict[str, Column] = {}
        for room, words in (*custom, *folders.items()):
            scores[room] = scores.get(room, F.lit(0)) + contained(lowered, words)
        return best_scored(list(scores.items()), "general")

    return F.coalesce(by_folder, by_stem, by_custom, bound(F.lower(F.substring(as_column(text), 1, head)), by_words))


def drawer_id(wing: Column | str, room: Column | str, source_file: Column | str, chunk_index: Column | str) -> Column:
    """``drawer_<wing>_<room>_`` and 16 digits of the MD5 of the file and the chunk's index."""
    digest = F.md5(F.concat(as_column(source_file), as_column(chunk_index).cast("string")).cast("binary"))
    return F.concat(F.lit("drawer_"), as_column(wing), F.lit("_"), as_column(room), F.lit("_"), F.substring(digest, 1, 16))
