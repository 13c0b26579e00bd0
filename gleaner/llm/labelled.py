"""Labelled documents for the prose rules: invented texts in five languages, made from a seed. True means list, table or
junk. Bounded by DOCUMENTS; nothing of the judged tables goes in."""

from __future__ import annotations

import random

DOCUMENTS = 1_800

#: Per language: sentence frames with slots {n} noun, {a} adjective, {p} name, {k} number; nouns; adjectives.
_LANGUAGES = {
    "en": (
        ["The {a} {n} was found near the {n} by {p} in the morning.", "We think that this {n} is more {a} than the old one, but nobody knows why.", "{p} said it would take {k} days before the {n} could be used again.", "There are {k} ways to open a {n} if the {n} is {a}.", "I'm sorry, but I can't say anything about the {n}.", "What happens when the {n} of {p} is too {a}?", "Each {a} {n} keeps that {n} with little effort, and {p} agrees."],
        ["window", "bridge", "report", "garden", "engine", "letter", "table", "river"], ["quiet", "large", "green", "late", "simple", "broken"],
    ),
    "de": (
        ["Die {a}e {n} wurde am Morgen von {p} in der Nähe gefunden.", "Wir glauben, dass diese {n} besser ist als die alte, aber niemand weiß warum.", "{p} sagte, es dauert {k} Tage, bis die {n} wieder benutzt werden kann.", "Es gibt {k} Wege, die {n} zu öffnen, wenn sie {a} ist.", "Was passiert, wenn die {n} von {p} zu {a} wird?", "Leider kann ich zu dieser {n} nichts sagen."],
        ["Brücke", "Maschine", "Liste", "Frage", "Kirche", "Straße"], ["klein", "still", "neu", "spät", "grün"],
    ),
    "fr": (
        ["La {n} {a} a été trouvée par {p} dans la matinée.", "Nous pensons que cette {n} est plus {a} que l'autre, mais personne ne sait pourquoi.", "{p} dit qu'il faut {k} jours avant que la {n} soit prête.", "Il y a {k} façons d'ouvrir la {n} si elle est {a}.", "Que se passe-t-il quand la {n} de {p} devient {a} ?", "Je suis désolé, je ne peux pas parler de la {n}."],
        ["porte", "lettre", "table", "rivière", "école"], ["rouge", "calme", "simple", "large"],
    ),
    "es": (
        ["La {n} {a} fue encontrada por {p} en la mañana.", "Creemos que esta {n} es más {a} que la otra, pero nadie sabe por qué.", "{p} dijo que hacen falta {k} días antes de que la {n} esté lista.", "Hay {k} maneras de abrir la {n} si es {a}.", "¿Qué pasa cuando la {n} de {p} se vuelve {a}?", "Lo siento, no puedo hablar de la {n}."],
        ["puerta", "carta", "mesa", "escuela", "casa"], ["roja", "simple", "grande", "verde"],
    ),
    "zh": (
        ["这个{a}的{n}是{p}在早上发现的。", "我们认为这个{n}比那个{n}更{a}，但是没有人知道为什么。", "{p}说要过{k}天才能再用这个{n}。", "如果每个{n}都很{a}，那么一共有{k}种办法。", "当{p}的{n}变得{a}时会发生什么？", "抱歉，关于这个{n}我不能回答。", "最好先读一读那个{n}，因为它把{p}和{n}放在一起了。"],
        ["窗户", "报告", "花园", "机器", "书信", "桌子", "河水"], ["安静", "巨大", "绿色", "简单", "陈旧"],
    ),
}
_SYLLABLES = ["ba", "ko", "lin", "mer", "su", "tov", "rai", "zen", "pu", "dal"]


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def name(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(2, 4))).capitalize()

    def sentence(self, lang: str) -> str:
        frames, nouns, adjectives = _LANGUAGES[lang]
        out = self.r.choice(frames)
        while "{" in out:
            for slot, value in (("{n}", self.r.choice(nouns)), ("{a}", self.r.choice(adjectives)), ("{p}", self.name()), ("{k}", str(self.r.randint(2, 9999)))):
                out = out.replace(slot, value, 1)
        return out

    def item(self, lang: str) -> str:
        _, nouns, adjectives = _LANGUAGES[lang]
        n, a = self.r.choice(nouns), self.r.choice(adjectives)
        thing = f"{a}的{n}" if lang == "zh" else self.r.choice([f"{a} {n}", f"{n}, {a}", f"{n} {a}"])
        return self.r.choice([thing, thing, f"{thing} {self.r.randint(1, 999)}", f"{self.name()} {thing}", f"{thing} ({self.name()})"])

    def prose(self, lang: str, least: int = 1, most: int = 8) -> str:
        gap = "" if lang == "zh" else " "
        parts = [self.sentence(lang) for _ in range(self.r.randint(least, most))]
        return "".join(p + (self.r.choice(["\n\n", gap, gap, gap]) if i + 1 < len(parts) else "") for i, p in enumerate(parts))

    def items(self, lang: str, least: int, most: int) -> list[str]:
        return [self.item(lang) for _ in range(self.r.randint(least, most))]

    def good(self, lang: str) -> str:
        r, kind = self.r, self.r.randrange(9)
        if kind == 0:
            return self.prose(lang, 3, 8) + "\n\n" + "\n".join(f"- {x}" for x in self.items(lang, 2, 4))
        if kind == 1:
            return self.prose(lang, 2, 6) + f'\n\n```\n$ {self.name().lower()} run {self.name().lower()}.{r.choice("abc")}_{r.randint(1, 99)}\n```'
        if kind == 2:
            text = self.prose(lang, 2, 8)
            return text[: max(30, int(len(text) * r.uniform(0.4, 0.98)))]
        if kind == 3:
            s = self.sentence(lang)
            return "\n".join(f"{i + 1}. {s}" for i in range(r.randint(3, 8))) if r.random() < 0.5 else (" " if lang != "zh" else "").join([s] * r.randint(3, 8))
        if kind == 5:
            # Prose that gets stuck in a turn of a few words.
            turn, gap = self.item(lang).split(" (")[0], "" if lang == "zh" else " "
            return self.prose(lang, 1, 3) + gap + "".join(turn + r.choice([gap, "，" if lang == "zh" else ", "]) for _ in range(r.randint(6, 30))) + "."
        if kind == 4:
            return self.sentence(lang).upper() if r.random() < 0.3 else f"**{self.sentence(lang)}**"
        return self.prose(lang)

    def bad(self, lang: str) -> str:
        r, kind = self.r, self.r.randrange(17)
        if kind <= 2:
            marks = r.choice([lambda i: "- ", lambda i: "* ", lambda i: "• ", lambda i: f"{i + 1}. ", lambda i: f"{i + 1}) ", lambda i: ""])
            rows = [marks(i) + x for i, x in enumerate(self.items(lang, 5, 16))]
            head = [{"zh": "要点如下：", "de": "Wichtig:", "fr": "Points :", "es": "Puntos:", "en": "Key points:"}[lang]] if r.random() < 0.3 else []
            return "\n".join(head + rows)
        if kind == 3:
            return ("、" if lang == "zh" else r.choice([", ", "; ", " / "])).join(self.items(lang, 8, 20))
        if kind == 4:
            return "\n".join(f"{self.name()}: {x}" for x in self.items(lang, 5, 14))
        if kind in (5, 6):
            cells = [[self.name(), self.item(lang), str(r.randint(1, 99999))] for _ in range(r.randint(4, 10))]
            how = r.randrange(5)
            if how == 0:
                return "\n".join(["| " + " | ".join(c) + " |" for c in cells[:1]] + ["|---|---|---|"] + ["| " + " | ".join(c) + " |" for c in cells[1:]])
            if how == 1:
                return "<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>" for c in cells) + "</table>"
            if how == 2:
                return "\n".join(f"{c[0]:<20}{c[1]:<24}{c[2]}" for c in cells)
            return "\n".join(r.choice(["\t", ",", ";"]).join(c) for c in cells)
        if kind == 7:
            return "\n".join(f'"{self.name()}";"{self.item(lang)}";"{r.randint(1, 99999)}"' for _ in range(r.randint(4, 9)))
        if kind == 8:
            return "\n".join(f"{r.randint(10**9, 10**12)} {r.choice(['INFO', 'ERR', 'WARN'])} [{self.name()}] code={r.randint(1, 9999)} {self.name().lower()}.x_{r.randint(1, 99)}" for _ in range(r.randint(3, 9)))
        if kind == 9:
            return " | ".join(self.name() for _ in range(r.randint(6, 20))) + " >>"
        if kind == 10:
            return " ".join(f"{r.randrange(256):02x}" for _ in range(r.randint(30, 120)))
        if kind == 11:
            return "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(r.randint(60, 400))) + "=="
        if kind == 12:
            return self.prose(lang, 1, 4).encode().decode("latin-1") if lang == "zh" else "".join(r.choice("�□▒ô┞à") for _ in range(r.randint(50, 250)))
        if kind == 13:
            return " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(40, 150)))
        if kind == 14:
            return "".join(r.choice("&/|\\[{*]}_~@%^-#=+<>$ ") for _ in range(r.randint(50, 300)))
        if kind == 15:
            return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 11))) for _ in range(r.randint(12, 60)))
        return "".join(f"\\x{r.randrange(256):02x}" for _ in range(r.randint(20, 90))) if r.random() < 0.5 else "".join(f"&#{r.randint(32, 9000)};" for _ in range(r.randint(15, 60)))


def documents(n: int = DOCUMENTS, seed: int = 7) -> list[tuple[str, bool]]:
    """(text, label) of n documents of at least 40 characters, as many of either label."""
    make, langs, out = _Maker(seed), list(_LANGUAGES), []
    while len(out) < n:
        label = len(out) % 2 == 1
        lang = langs[len(out) // 2 % len(langs)]
        text = make.bad(lang) if label else make.good(lang)
        # Either label comes cut and without its last stop just as often, so neither tells them apart.
        if make.r.random() < 0.4:
            text = text[: max(45, int(len(text) * make.r.uniform(0.3, 0.98)))] + make.r.choice(["", "", "…", "...", " [..."])
        elif make.r.random() < 0.3:
            text = text.rstrip(".。?!=\n ")
        if len(text) >= 40 or not label:
            out.append((text, label))
    return out
