"""Common words of some languages."""

from __future__ import annotations

# Words that are frequent in a language and, as a set, tell it from the others.
COMMON_WORDS = {
    "de": "der die das und ist nicht mit ein eine zu von auf für dem den sich im",
    "en": "the of and to in is that it for was on are with they at be this have from",
    "es": "el los las que y en una por con para como del se su más lo",
    "fr": "le les des et est une du que pour dans qui ce il pas par sur avec au",
}
