"""Speech transcripts into clean speaker turns by a sequence model over tokens.

Tokens are tagged as speaker label, time mark, note of a noise, hesitation sound or speech by a linear chain, learned by
a perceptron with averaged weights and decoded by Viterbi. Nothing but its tags decides what is kept. It learns from

- label tokens, known because the speaker stands in a field of its own in structured calls;
- speech and its disturbances, known by their use: what is put into speech at random leaves, when taken out, neighbours
  that stand side by side elsewhere, and words don't. Tokens whose kind occurs often enough to tell are labelled by this
  share, all others are left open, and the chain fills them in while it learns;
- a few lines labelled by hand (STARTER), so that small tables have a model too.

What the chain sees is another matter: the form of a token and of its neighbours, and its place in the line.
Training takes at most TRAIN calls, the least by hash of their id; labels are resolved against the call's roster,
whatever form the name takes, pieces are put in order and joined.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Calls at most that the model is trained on.
TRAIN = 120
EPOCHS = 8
#: By how much learned tags must win, for averaged weights that stand clear of the border.
MARGIN = 2.0
#: A kind of token is judged by its use from this number of occurrences on: put in at random from the first share on
#: if no neighbour has more than the third, part of speech up to the second or if one has twice the third.
OFTEN, PUT_IN, SPOKEN, CHOICE = 5, 0.5, 0.1, 0.12
#: Ties go to the first.
TAGS = ("TALK", "SPEAKER", "TIME", "NOTE", "FILL")
TALK, SPEAKER, TIME, NOTE, FILL = range(5)

_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_MARK = re.compile(rf"^[\[(<{{]?\s*({_CLOCK})\s*[\])>}}]?$")
#: What stands in brackets of any kind is one token, however long, but for round ones with more than one word, which
#: speech has too: those are tokens of their own where they are set off by nothing else.
_TOKEN = re.compile(r"[\[<{][^\]>}\[<{\n]*[\]>}]|\(\([^()\n]*\)\)|\(\s*\d[\d:.,]*\s*\)|\*[^\W\d_][^*\n]*\*|♪[^♪\n]*♪|\S+")
_EDGE = ".,;:!?…—–-\"'“”‘’()[]"
#: Labels of the operator, and of voices that the roster doesn't know.
_OPERATORS = {"operator", "moderator", "conference operator", "coordinator", "conference moderator", "host", "the operator"}
_VOICES = re.compile(r"^(?:unknown|unidentified|audience|speaker|male|female|participant|voice|multiple)\b[\w ]{0,20}$", re.IGNORECASE)
#: Short forms of titles.
_TITLES = {"ceo": "chief executive officer", "cfo": "chief financial officer", "coo": "chief operating officer", "cto": "chief technology officer", "ir": "head of investor relations", "chair": "chairman"}
_HONOUR = re.compile(r"^(?:mr|mrs|ms|miss|dr|prof|sir|madam|herr|frau)\.?\s+", re.IGNORECASE)


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits (one character put in, left out, changed, or two neighbours swapped) from a to b; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for k, y in enumerate(b, 1):
            d = min(last[k] + 1, row[k - 1] + 1, last[k - 1] + (x != y))
            if before is not None and k > 1 and x == b[k - 2] and a[i - 2] == y:
                d = min(d, before[k - 2] + 1)
            row.append(d)
        before, last = last, row
    return min(last[-1], most + 1)


class Roster:
    """Who took part in a call: (speaker, role, title) each."""

    def __init__(self, people: list[tuple[str, str | None, str | None]]) -> None:
        self.people = sorted({(s, r or "", t or "") for s, r, t in people if s})
        self.known: dict[str, tuple[str, str | None]] = {}
        #: No label is longer than the longest name, title and firm together with a lead-in.
        self.longest = max((len(s) + len(t) for s, _, t in self.people), default=0) + 40

    def resolve(self, label: str) -> tuple[str, str | None]:
        """How a label resolves (name, voice or none) and to whom."""
        if label not in self.known:
            self.known[label] = self._resolve(label)
        return self.known[label]

    def _only(self, found: list[str]) -> str | None:
        return found[0] if len(set(found)) == 1 else None

    def _resolve(self, label: str) -> tuple[str, str | None]:
        text = re.sub(r"\s+", " ", label.replace(">>", " ")).strip().rstrip(":").strip()
        bare = re.sub(r"\s*\([^)]*\)\s*$", "", text)
        bare = re.split(r"\s+(?:--|-|–|—)\s+", bare)[0].strip().casefold()
        if not bare or len(bare) > self.longest:
            return "none", None
        if bare in _OPERATORS:
            operator = self._only([s for s, r, _ in self.people if r.casefold() == "operator"])
            return ("name", operator or "Operator")
        if _VOICES.match(bare):
            return "voice", None
        forms = {bare}
        if bare.count(",") == 1:
            last, first = (x.strip() for x in bare.split(","))
            forms.add(f"{first} {last}")
        plain = _HONOUR.sub("", bare)
        title = _TITLES.get(bare, bare)
        for test in (
            lambda s, r, t: s in forms,
            lambda s, r, t: s.split()[-1] == plain,
            lambda s, r, t: len(plain.split()) == 2 and re.fullmatch(r"\w\.?", plain.split()[0]) and s[0] == plain[0] and s.split()[-1] == plain.split()[-1],
            lambda s, r, t: t and t == title,
            lambda s, r, t: r == "analyst" and re.search(r"\banalyst\b", bare) and s.split()[-1] == bare.split()[-1],
            lambda s, r, t: s.split()[0] == plain,
            lambda s, r, t: any(distance(s, f) <= 2 for f in forms) and " " in s,
            lambda s, r, t: len(plain) > 4 and distance(s.split()[-1], plain.split()[-1]) <= 2 and (len(plain.split()) == 1 or s[0] == plain[0] or re.search(r"\banalyst\b", bare)),
        ):
            if found := [s for s, r, t in self.people if test(s.casefold(), r.casefold(), t.casefold())]:
                who = self._only(found)
                if who is None:  # several: the nearest by edits, then the first by name
                    who = min(found, key=lambda s: (distance(s.casefold(), bare, 9), s))
                return "name", who
        return "none", None


_WRAPS = {"[": "]", "(": ")", "<": ">", "{": "}", "*": "*", "♪": "♪"}


def shape(token: str) -> str:
    """Runs of letters as x or X, of digits as 0; marks as they are."""
    return re.sub(r"[^\W\d_]+", lambda m: "X" if m.group()[0].isupper() else "x", re.sub(r"\d+", "0", token))


def squeezed(token: str) -> str:
    """The token in lower case without outer marks, repeated letters once."""
    return re.sub(r"([^\W\d_])\1+", r"\1", token.strip(_EDGE).lower())


def wrapped(token: str) -> str:
    """The mark that opens a token, if its partner closes it."""
    return token[0] if len(token) > 2 and _WRAPS.get(token[0]) == token.rstrip(".,;:!?")[-1:] else ""


def _case(token: str | None) -> str:
    if token is None:
        return "end"
    core = token.lstrip("\"'“‘(")
    return "0" if core[:1].isdigit() else "X" if core[:1].isupper() else "x" if core[:1].isalpha() else core[:1]


def _last(token: str | None) -> str:
    """How the token before ends."""
    if token is None:
        return "start"
    return token[-1] if not token[-1].isalnum() else "w"


#: What the chain sees of a token: itself, place in a label (or after it), and the cases and ends of its neighbours.
Seen = tuple[str, str, str, str]


def seen(lines: list[list[str]], roster: Roster) -> list[Seen]:
    """What is seen of each token of a piece's lines, in one sequence.

    The stretch of a line up to its first colon, time marks before it left out, is a possible label: the roster says
    whether it names somebody, and how far a token is from its start.
    """
    out = []
    for tokens in lines:
        first = 0
        while first < len(tokens) and _MARK.match(tokens[first]):
            first += 1
        end = next((i + 1 for i in range(first, len(tokens)) if tokens[i].endswith(":")), first)
        how = roster.resolve(" ".join(tokens[first:end]))[0] if end > first else "none"
        for i, t in enumerate(tokens):
            if first <= i < end:
                place = f"{how}{min(i - first, 3)}{'-' if i + 1 < end else '$'}{min(end - first, 9)}"
            else:
                place = "head" if i < first else "after" if i == end else "in"
            out.append((t, place, _case(tokens[i + 1] if i + 1 < len(tokens) else None), _last(tokens[i - 1] if i else None)))
    return out


def features(x: Seen) -> tuple[str, ...]:
    token, place, after, before = x
    form, word = shape(token), squeezed(token)
    ends = token[-1] if not token[-1].isalnum() else "w"
    letters = set(word) - set("-")
    sound = "sound" if letters and letters <= set("aehmru") and len(word) <= 5 else "word"
    short = word if len(word) <= 4 else "long"
    region = place.rstrip("0123456789").rstrip("-$").rstrip("0123456789")
    return (
        f"form={form}" if len(form) <= 12 else "form=long", f"word={short}", f"word.={short}|{ends}", f"sound={sound}|{ends}|{form[:1]}|{after}", f"sound={sound}|{ends == '.'}", f"wrapped={wrapped(token)}{any(c.isalpha() for c in token)}", f"clock={'0:0' in form}{any(c.isalpha() for c in token)}", f"place={place}", f"region={region}",
        f"form@={form if len(form) <= 12 else 'long'}|{region}", f"near={form if len(form) <= 12 else 'long'}|{before}|{after}", f"ends={ends}|{region}", "1",
    )


class Tagger:
    """Weights of (feature, tag) and of neighbouring tags."""

    def __init__(self, weights: dict[str, list[float]], moves: list[list[float]]) -> None:
        self.weights, self.moves = weights, moves
        flat = [x for row in moves for x in row]
        #: What a tag can gain from both its neighbours at most, against another.
        self.swing = 2 * (max(flat) - min(flat))
        self.known: dict[Seen, tuple[list[float], int]] = {}

    def emission(self, x: Seen) -> list[float]:
        zero = [0.0] * len(TAGS)
        return [sum(v) for v in zip(*[self.weights.get(f, zero) for f in features(x)], strict=True)]

    def sure(self, x: Seen) -> tuple[list[float], int]:
        """Scores of the tags, and the tag that no neighbour can overrule, or -1."""
        hit = self.known.get(x)
        if hit is None:
            if len(self.known) > 300_000:
                self.known.clear()
            e = self.emission(x)
            first, second = sorted(e, reverse=True)[:2]
            hit = self.known[x] = (e, e.index(first) if first - second > self.swing else -1)
        return hit

    def tags(self, row: list[Seen]) -> list[int]:
        """The best tags, by Viterbi; it need not run where every tag is beyond its neighbours' reach."""
        found = [self.sure(x) for x in row]
        if all(t >= 0 for _, t in found):
            return [t for _, t in found]
        return viterbi([e for e, _ in found], self.moves)


def viterbi(emissions: list[list[float]], moves: list[list[float]]) -> list[int]:
    n = len(TAGS)
    if not emissions:
        return []
    score, back = emissions[0], []
    for e in emissions[1:]:
        step, new = [], []
        for b in range(n):
            best, top = 0, score[0] + moves[0][b]
            for a in range(1, n):
                if (v := score[a] + moves[a][b]) > top:
                    best, top = a, v
            step.append(best)
            new.append(top + e[b])
        back.append(step)
        score = new
    tag = score.index(max(score))
    tags = [tag]
    for step in reversed(back):
        tag = step[tag]
        tags.append(tag)
    return tags[::-1]


#: Lines labelled by hand; a letter and a bar set the tag from a token on (S label, T time, N note,
#: F hesitation, W speech).
STARTER = """
S|Operator: W|Good morning and welcome to the call.
W|She, a, girl, are here; her arm, a hum, me, Mr. Ham: a, be, a, or a mere, era.
W|We saw a, one-off gain in a, year (mainly a, rebate), a, b, and a, c.
S|Jane Miller: F|Um, W|thank you. We saw F|uh W|good growth in Q3.
S|John Q. Smith -- Chief Executive Officer: W|The filing goes out at 4:30 p.m. Eastern, N|(laughter) W|as planned.
T|[00:01:15] S|Jane Miller: W|The ratio was 3:1 before the split.
S|Jane Miller: T|[00:01:15] W|Three things matter: (1) price; (2) mix; (3) volume.
T|(0:02:10) S|M. Brown: W|Dr. M. A. Hill joined the board, F|erm, W|in May.
T|<00:04:10> W|Sales fell (mainly weather) and F|hmm... W|margins held.
T|[00:01:15.250] S|Unknown: N|[inaudible]
S|>> Speaker 1: N|(applause)
T|00:12:05 S|Operator: W|Our next question comes from the queue.
S|J. Miller: W|We could F|er W|lower N|{background noise} W|our view (in constant currency) of F|ah, W|costs.
S|Analyst: W|Two points: volume held, and N|((phone rings)) W|price is N|<crosstalk> W|behind N|*coughs* W|us. N|♪ music ♪
W|One more thing: the plan F|mm-hmm, W|stands. We call M. Stone at 9:15 tomorrow.
S|MILLER, JANE: F|Uhm — W|most of it came from the U.S. and E. H. Hart.
W|Well, you know, I mean N|[pause] W|it is fine. T|[00:02:36] W|We go on. N|[inaudible 00:14:22] W|Yes.
S|Ms. Miller: W|Rated A. See slide No. 12 at 10:30. F|Ehm... W|It is a river.
F|Hmm W|That ends the call at 6 a.m. on F|ah, W|Monday, F|er, W|or F|mm-hmm... W|later.
S|Operator: F|Hmm W|Please go ahead. F|Uh, W|your line F|uhh W|is F|umm, W|open to F|erm... W|us.
F|ah W|The sale cost F|ah W|us 3 bps; F|uhm W|we F|ehm, W|move F|mm-hmm W|on in F|hmm, W|May.
T|[00:03:21] S|Hart, Ed (Firm Partners): W|Prices held.
T|00:01:04 W|Orders rose again! A. S. Hill retires. S|Operator: T|00:00:56 W|Please go on.
T|(0:03:15) S|>> jane miller: W|Costs fell.
W|Costs fell, F|um, er.
N|♪ theme ♪ W|First, F|uhm, uh.
S|>> E. Hart: W|K. Ray and A. May retire.
S|Mary Brown -- Firm Partners: F|uhh W|Costs fell.
T|<00:11:05> F|uhh W|Two of them: we grew, and fell.
W|The read is T|(0:02:48) W|that mix F|ah W|cost us, and T|(0:05:04) W|Did it pay? T|<00:01:37> W|We believe F|uhm... W|Gorm and T|[00:03:01] W|Hale stay at T|(0:01:10) W|5 p.m.
W|Growth was 24.6%, F|ah, W|whereas costs T|[00:02:31.500] W|fell to $3.6 F|ah W|last year.
"""


def starters() -> list[tuple[list[Seen], list[int | None]]]:
    people = [("Jane Miller", "executive", "Treasurer"), ("John Q. Smith", "executive", "Chief Executive Officer"), ("Mary Brown", "analyst", "Firm Partners"), ("Ed Hart", "analyst", "Firm Partners"), ("Operator", "operator", None)]
    out = []
    for line in STARTER.strip().split("\n"):
        tokens, tags, tag = [], [], TALK
        for part in re.split(r"\s+(?=[STNFW]\|)", line):
            letter, words = part.split("|", 1)
            tag = "WSTNF".index(letter)
            found = _TOKEN.findall(words)
            tokens += found
            tags += [tag] * len(found)
        out.append((seen([tokens], Roster(people)), tags))
    return out


def _type(token: str) -> str:
    """What is counted together: form and squeezed word of a token, its digits and the words in brackets left out."""
    if mark := wrapped(token):
        return mark + ("0:" if re.search(r"\d:\d", token) else "x" if any(c.isalpha() for c in token) else "0")
    word = squeezed(token)
    return re.sub(r"\d+", "0", word) + ("." if token.rstrip("\"')").endswith(".") and not token.endswith("..") else "")


def usage(texts: list[list[str]]) -> dict[str, bool | None]:
    """For each kind of token that occurs OFTEN: whether it is put into speech at random (True), a word (False), or open.

    What is put in leaves, when taken out, neighbours that stand side by side elsewhere, and any word may stand before
    and after it. A word leaves a gap, or chooses its neighbours.
    """

    def fold(t: str) -> str:
        """The word, with a stop where a sentence ends in it: what stands on both sides of one is not side by side."""
        return re.sub(r"\d+", "0", t.strip(_EDGE).lower()) + ("." if t[-1] in ".!?" and not t.endswith("..") else "")

    # What is said again and again in the same words shows its neighbours once.
    bare = list({tuple(map(fold, b)): b for b in ([t for t in tokens if any(c.isalnum() for c in t) or "♪" in t] for tokens in texts)}.values())
    triples: Counter = Counter()
    for tokens in bare:
        w = ["<s>", *map(fold, tokens), "</s>"]
        triples.update(zip(w, w[1:], w[2:], strict=False))
    n: Counter = Counter()
    out: Counter = Counter()
    sides: dict[str, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    for tokens in bare:
        w = ["<s>", *map(fold, tokens), "</s>"]
        for i in range(1, len(w) - 1):
            k = _type(tokens[i - 1])
            left = i > 1 and triples[(w[i - 2], w[i - 1], w[i + 1])] > 0
            right = i + 2 < len(w) and triples[(w[i - 1], w[i + 1], w[i + 2])] > 0
            n[k] += 1
            out[k] += left or right
            if i > 1 and i + 2 < len(w):
                sides[k][0][w[i - 1]] += 1
                sides[k][1][w[i + 1]] += 1
    found: dict[str, bool | None] = {}
    for k, v in n.items():
        if v >= OFTEN:
            inner = sum(sides[k][0].values())
            top = max(max(c.values()) for c in sides[k]) / inner if inner >= OFTEN else 0.0
            found[k] = True if out[k] / v >= PUT_IN and top <= CHOICE + 1 / max(inner, OFTEN) else False if out[k] / v <= SPOKEN or top >= 2 * CHOICE else None
    return found


def _open_labels(tokens: list[str], use: dict[str, bool | None]) -> list[int | None]:
    """Tags by use where it is plain; what is put in has its tag by whether it counts time, is bracketed, or neither."""
    out: list[int | None] = []
    for t in tokens:
        put_in = use.get(_type(t))
        if not any(c.isalnum() for c in t) and "♪" not in t or put_in is False:
            out.append(TALK)
        elif put_in:
            out.append(TIME if _MARK.match(t) else NOTE if wrapped(t) else FILL)
        else:
            out.append(None)
    return out


def learn(calls: list[tuple[list[tuple[str | None, str]], list]]) -> Tagger:
    """The averaged perceptron over pieces of the calls, in their order; open tags are the best under the weights."""
    read = [(who, [_TOKEN.findall(x) for x in text.split("\n")], people) for pieces, people in calls for who, text in pieces]
    use = usage([[t for line in lines for t in line] for _, lines, _ in read])
    data, rosters, before = starters() * 10, {}, None
    for who, lines, people in read:
        roster = rosters.setdefault(id(people), Roster(people))
        label = _TOKEN.findall(_labelled(who, "")) if (who or "").strip() else []
        body = [t for line in lines for t in line]
        # Transcripts have the time mark before the label or after it, and the label on a line of its own or not.
        ahead = 1 if body and _MARK.match(body[0]) and len(data) % 2 else 0
        gold = _open_labels(body, use)
        tokens = [body[:ahead] + label] if label and len(data) % 3 == 0 else []
        tokens += [([] if tokens else body[:ahead] + label) + body[ahead:]]
        if body or label:
            one = (seen(tokens, roster), gold[:ahead] + [SPEAKER] * len(label) + gold[ahead:])
            # Pieces follow one another as the lines of a block, too.
            if before is people and len(data) % 3 and len(data[-1][1]) < 200:
                data[-1] = (data[-1][0] + one[0], data[-1][1] + one[1])
                before = None
            else:
                data.append(one)
                before = people
    n = len(TAGS)
    w: dict[str, list[float]] = defaultdict(lambda: [0.0] * n)
    sums: dict[str, list[float]] = defaultdict(lambda: [0.0] * n)
    moves, move_sums, step = [[0.0] * n for _ in range(n)], [[0.0] * n for _ in range(n)], 1
    told = [([features(x) for x in row], tags) for row, tags in data]
    for _ in range(EPOCHS):
        for feats, tags in told:
            e = [[sum(v) for v in zip(*[w[f] for f in fs], strict=True)] for fs in feats]
            # Tags other than the right ones are MARGIN ahead; open ones are filled in by the best way through.
            got = viterbi([x if g is None else [v + MARGIN * (k != g) for k, v in enumerate(x)] for x, g in zip(e, tags, strict=True)], moves)
            if any(g is not None and g != k for g, k in zip(tags, got, strict=True)):
                gold = viterbi([x if g is None else [v if k == g else -1e9 for k, v in enumerate(x)] for x, g in zip(e, tags, strict=True)], moves)
                for i, (a, b) in enumerate(zip(gold, got, strict=True)):
                    if a != b:
                        for f in feats[i]:
                            w[f][a] += 1
                            w[f][b] -= 1
                            sums[f][a] += step
                            sums[f][b] -= step
                    if i and (gold[i - 1], a) != (got[i - 1], b):
                        moves[gold[i - 1]][a] += 1
                        move_sums[gold[i - 1]][a] += step
                        moves[got[i - 1]][b] -= 1
                        move_sums[got[i - 1]][b] -= step
            step += 1
    average = {f: [x - s / step for x, s in zip(v, sums[f], strict=True)] for f, v in w.items()}
    return Tagger(average, [[x - s / step for x, s in zip(a, b, strict=True)] for a, b in zip(moves, move_sums, strict=True)])


def _labelled(who: str | None, text: str) -> str:
    who = (who or "").strip()
    return f"{who.rstrip(':').strip()}: {text}" if who else text


#: A piece: its tokens, and their tags.
Piece = tuple[list[str], list[int]]


def _tagged(text: str, roster: Roster, tagger: Tagger) -> list[Piece]:
    """The lines of a text with their tags, all decoded as one sequence."""
    lines = [x for x in map(_TOKEN.findall, text.split("\n")) if x]
    tags = tagger.tags(seen(lines, roster))
    out, at = [], 0
    for tokens in lines:
        out.append((tokens, tags[at : at + len(tokens)]))
        at += len(tokens)
    return out


def pieces_of(content: str | None, structured: list[dict] | None, roster: Roster, tagger: Tagger) -> list[Piece]:
    """The pieces of a call: those of the structure, or the blocks of the text and, in them, the lines that begin one.

    A line begins a piece if it begins with a label, or with a time mark where no bare label is before it.
    """
    out: list[Piece] = []
    if structured:
        for x in structured:
            if x and (lines := _tagged(_labelled(x["speaker"], x["text"] or ""), roster, tagger)):
                out.append(([t for tokens, _ in lines for t in tokens], [g for _, tags in lines for g in tags]))
        return out
    for block in re.split(r"\n[ \t\r]*\n", content or ""):
        bare, held = False, False
        for tokens, tags in _tagged(block, roster, tagger):
            lead = next((g for g in tags if g != TIME), TIME)
            if not held or lead == SPEAKER or tags[0] == TIME and not bare:
                out.append((list(tokens), list(tags)))
            else:
                out[-1][0].extend(tokens)
                out[-1][1].extend(tags)
            held, bare = True, all(g in (SPEAKER, TIME) for g in tags) and SPEAKER in tags
    return out


def _seconds(token: str) -> float:
    total = 0.0
    for x in _MARK.match(token).group(1).replace(",", ".").split(":"):
        total = total * 60 + float(x)
    return total


def turns_of(content: str | None, structured: list[dict] | None, people: list, tagger: Tagger) -> list[tuple[str | None, str, int]]:
    """(speaker, clean text, number of words) of each turn, in the order spoken."""
    roster = Roster(people)
    read = []
    for tokens, tags in pieces_of(content, structured, roster, tagger):
        # The label is the run of its tokens at the head; a tag of it elsewhere is speech.
        first = next((i for i, g in enumerate(tags) if g not in (TIME, NOTE, FILL)), len(tags))
        last = next((i for i in range(first, len(tags)) if tags[i] != SPEAKER), len(tags))
        label = " ".join(tokens[first:last])
        mark = next((_seconds(tokens[i]) for i in (*range(first), last) if i < len(tags) and tags[i] == TIME and _MARK.match(tokens[i])), None)
        words = [t for i, (t, g) in enumerate(zip(tokens, tags, strict=True)) if g == TALK or g == SPEAKER and not first <= i < last]
        how, who = roster.resolve(label) if label else ("none", None)
        read.append((mark, how, who, words, label))
    if read and all(r[0] is not None for r in read):
        read.sort(key=lambda r: r[0])
    turns: list[list] = []
    for _, how, who, words, label in read:
        n = sum(any(c.isalnum() for c in w) for w in words)
        if not n:
            continue
        if how != "name":
            who = turns[-1][0] if turns and not label else re.sub(r"\s+", " ", label.replace(">>", "")).strip(" :") or None
        if turns and turns[-1][0] == who:
            turns[-1][1] += words
            turns[-1][2] += n
        else:
            turns.append([who, list(words), n])
    return [(who, " ".join(words), n) for who, words, n in turns]


def clean_turns(calls: DataFrame, roster: DataFrame, *, key: str, content: str, structured: str) -> DataFrame:
    """`key`, turn_no (from 0), speaker, text, n_words: the clean turns of each call.

    structured (array of speaker, role, section, text) counts where it is filled, else content. `roster` has key,
    speaker, role and title. Rows with null key are left out; of several rows of a key the greatest counts, so repeated
    rows change nothing. A call without a word has no turn; the first piece of a call without any label has a null
    speaker, a label that the roster doesn't hold is kept as it is.
    """
    # Both sides by key, with a number of partitions that adapts to the bytes: the join needs no further shuffle.
    one = calls.where(F.col(key).isNotNull()).repartition(key).groupBy(key).agg(F.max(F.struct(F.col(content).alias("c"), F.col(structured).alias("s"))).alias("m"))
    who = roster.where(F.col(key).isNotNull()).repartition(key).groupBy(key).agg(F.collect_set(F.struct("speaker", "role", "title")).alias("people"))
    rows = one.join(who, key, "left").select(key, F.col("m.c").alias("c"), F.col("m.s").alias("s"), "people")
    some = [
        ([(x["speaker"], x["text"] or "") for x in r["s"]], [tuple(p) for p in r["people"] or []])
        for r in rows.where(F.size("s") > 0).orderBy(F.xxhash64(key), key).limit(TRAIN).collect()
    ]
    model = learn(some)
    sent = calls.sparkSession.sparkContext.broadcast((model.weights, model.moves))
    id_type = calls.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(*sent.value)
        for b in batches:
            rows, out = [], []
            for i, (c, s, people) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                for turn_no, (speaker, text, n) in enumerate(turns_of(c, s, [(p["speaker"], p["role"], p["title"]) for p in people or []], tagger)):
                    rows.append(i)
                    out.append((turn_no, speaker, text, n))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], names=[key, "turn_no", "speaker", "text", "n_words"])

    return rows.mapInArrow(run, f"`{key}` {id_type}, turn_no int, speaker string, text string, n_words int")
