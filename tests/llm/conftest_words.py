import re

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return _WORD.findall(text or "")
