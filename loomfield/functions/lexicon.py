"""Marker words, stop words and file name patterns."""

from __future__ import annotations

from dataclasses import dataclass

# Epistemic markers, Swedish then English.
HEDGE = (
    "kanske", "möjligen", "troligen", "eventuellt", "förmodligen", "antagligen", "sannolikt", "osäkert", "oklart", "torde",
    "borde", "kunde", "verkar", "tycks", "tyckas", "i viss mån", "till viss del", "det är möjligt", "det kan vara", "inte nödvändigtvis", "å andra sidan",
    "perhaps", "maybe", "possibly", "probably", "likely", "might", "could", "would", "seemingly", "apparently", "arguably", "presumably", "supposedly", "uncertain",
    "it seems", "it appears", "to some extent", "in a sense", "not necessarily", "on the other hand", "however", "although", "nevertheless", "nonetheless",
)
CERTAINTY = (
    "definitivt", "absolut", "utan tvekan", "givetvis", "självklart", "faktiskt", "verkligen", "alltid", "aldrig", "måste",
    "definitely", "absolutely", "certainly", "undoubtedly", "clearly", "obviously", "always", "never", "must", "proven", "established", "without doubt", "in fact", "indeed",
)
CHALLENGE = (
    "varför", "hur kan", "stämmer det", "är det verkligen", "ifrågasätta", "kritisera", "motsäga", "problematisera",
    "why", "how can", "is it really", "question", "challenge", "contradict", "dispute", "problematic", "debatable", "controversial", "paradox", "tension", "conflict",
)

# Words that never become terms.
STOP_WORDS = tuple(
    "the and for are but not you all can had her was one our out has have been from this that with they will each make like into over such than them then "
    "these some would other about which their there could more very when what your also most only after being those does were where just should through "
    "between before because while during without within upon both its own".split()
)

# File names, as patterns over the lower-cased name.
AUDIO = r"\.(mp3|wav|m4a|ogg|flac|webm)$"
IMAGE = r"\.(png|jpe?g|webp|gif|bmp)$"
SCRIPT = r"\.(js|jsx|ts|tsx|py|rb|go|rs|java|kt|swift|c|cc|cpp|h|hpp|cs|php|sh|bash|zsh|sql|r|lua)$"
ARCHIVE_SCRIPT = r"(?i)\.(js|jsx|ts|tsx|py|rb|go|rs|java|kt|swift|c|cc|cpp|h|hpp|cs|php|sh|bash|zsh|sql|r|lua|dart|scala|clj|ex|exs)$"
ARCHIVE_TEXT = r"(?i)\.(txt|md|markdown|rst|csv|tsv|json|yaml|yml|toml|xml|html|htm|tex)$"
ARCHIVE_IMAGE = r"(?i)\.(png|jpg|jpeg|webp|gif)$"
# Paths inside archives that are noise; folder names as they are, endings in any case.
EXCLUDED = (
    r"(^|/)(node_modules|\.git|\.next|dist|build|\.cache|coverage|__pycache__)/"
    r"|(?i:\.lock$|package-lock\.json$|yarn\.lock$|bun\.lock(b)?$|(^|/)\.env(\..*)?$"
    r"|\.(png|jpg|jpeg|gif|webp|ico|svg|pdf|zip|tar|gz|bz2|7z|rar|exe|dll|so|dylib|bin|wasm|woff2?|ttf|otf|mp3|mp4|mov|avi|mkv|wav|m4a)$"
    r"|\.min\.(js|css)$|\.map$)"
)


@dataclass(frozen=True)
class Lexicon:
    """Three marker lists; a marker with a blank is a phrase."""

    hedge: tuple[str, ...] = HEDGE
    certainty: tuple[str, ...] = CERTAINTY
    challenge: tuple[str, ...] = CHALLENGE
