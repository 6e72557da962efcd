"""Law citations in text (X20, X21, X22): what tasks run on one text.

Of the patterns of laws, the first in their order that a citation matches anywhere decides. They are one alternation, which at
each place prefers the first in order; so a pass over all places at which any of them matches finds the least, without trying
each pattern on the whole text.
"""

import re
from collections.abc import Iterator

# Patterns of law names, in order, with the name that each stands for (# is what its brackets hold).
LAWS = [
    (r"c[óo]digo\s*civil", "Código Civil"),
    (r"\bcc\b", "Código Civil"),
    (r"c[óo]digo\s*penal", "Código Penal"),
    (r"\bcp\b", "Código Penal"),
    (r"c[óo]digo\s*(?:do\s*)?trabalho", "Código do Trabalho"),
    (r"\bct\b", "Código do Trabalho"),
    (r"c[óo]digo\s*(?:de\s*)?processo\s*civil", "Código de Processo Civil"),
    (r"\bcpc\b", "Código de Processo Civil"),
    (r"c[óo]digo\s*(?:de\s*)?processo\s*penal", "Código de Processo Penal"),
    (r"\bcpp\b", "Código de Processo Penal"),
    (r"c[óo]digo\s*(?:de\s*)?processo\s*(?:do\s*)?trabalho", "Código de Processo do Trabalho"),
    (r"\bcpt\b", "Código de Processo do Trabalho"),
    (r"c[óo]digo\s*(?:de\s*)?processo\s*(?:nos\s*)?tribunais\s*administrativos", "Código de Processo nos Tribunais Administrativos"),
    (r"\bcpta\b", "Código de Processo nos Tribunais Administrativos"),
    (r"c[óo]digo\s*(?:do\s*)?procedimento\s*administrativo", "Código do Procedimento Administrativo"),
    (r"\bcpa\b", "Código do Procedimento Administrativo"),
    (r"c[óo]digo\s*(?:de\s*)?procedimento\s*e\s*(?:de\s*)?processo\s*tribut[áa]rio", "Código de Procedimento e de Processo Tributário"),
    (r"\bcppt\b", "Código de Procedimento e de Processo Tributário"),
    (r"constitui[çc][ãa]o(?:\s*da\s*rep[úu]blica)?(?:\s*portuguesa)?", "Constituição da República Portuguesa"),
    (r"\bcrp\b", "Constituição da República Portuguesa"),
    (r"c[óo]digo\s*(?:das\s*)?sociedades(?:\s*comerciais)?", "Código das Sociedades Comerciais"),
    (r"\bcsc\b", "Código das Sociedades Comerciais"),
    (r"c[óo]digo\s*(?:da\s*)?insolv[êe]ncia", "Código da Insolvência e da Recuperação de Empresas"),
    (r"\bcire\b", "Código da Insolvência e da Recuperação de Empresas"),
    (r"c[óo]digo\s*(?:dos\s*)?contratos\s*p[úu]blicos", "Código dos Contratos Públicos"),
    (r"\bccp\b", "Código dos Contratos Públicos"),
    (r"c[óo]digo\s*(?:dos\s*)?valores\s*mobili[áa]rios", "Código dos Valores Mobiliários"),
    (r"\bcvm\b", "Código dos Valores Mobiliários"),
    (r"c[óo]digo\s*(?:da\s*)?estrada", "Código da Estrada"),
    (r"c[óo]digo\s*comercial", "Código Comercial"),
    (r"\bccom\b", "Código Comercial"),
    (r"c[óo]digo\s*(?:do\s*)?registo\s*civil", "Código do Registo Civil"),
    (r"c[óo]digo\s*(?:do\s*)?registo\s*comercial", "Código do Registo Comercial"),
    (r"c[óo]digo\s*(?:do\s*)?registo\s*predial", "Código do Registo Predial"),
    (r"c[óo]digo\s*(?:do\s*)?notariado", "Código do Notariado"),
    (r"c[óo]digo\s*(?:do\s*)?direito\s*(?:de\s*)?autor", "Código do Direito de Autor e dos Direitos Conexos"),
    (r"c[óo]digo\s*(?:da\s*)?propriedade\s*industrial", "Código da Propriedade Industrial"),
    (r"c[óo]digo\s*(?:da\s*)?publicidade", "Código da Publicidade"),
    (r"c[óo]digo\s*(?:das\s*)?expropria[çc][õo]es", "Código das Expropriações"),
    (r"c[óo]digo\s*cooperativo", "Código Cooperativo"),
    (r"\bcirs\b", "Código do IRS"),
    (r"c[óo]digo\s*(?:do\s*)?irs", "Código do IRS"),
    (r"\bcirc\b", "Código do IRC"),
    (r"c[óo]digo\s*(?:do\s*)?irc", "Código do IRC"),
    (r"\bciva\b", "Código do IVA"),
    (r"c[óo]digo\s*(?:do\s*)?iva", "Código do IVA"),
    (r"c[óo]digo\s*(?:do\s*)?imposto\s*(?:de\s*)?selo", "Código do Imposto de Selo"),
    (r"\bcis\b", "Código do Imposto de Selo"),
    (r"c[óo]digo\s*(?:do\s*)?iuc", "Código do IUC"),
    (r"c[óo]digo\s*(?:do\s*)?imi", "Códigos do IMI e do IMT"),
    (r"c[óo]digo\s*(?:do\s*)?imt", "Códigos do IMI e do IMT"),
    (r"lei\s*geral\s*tribut[áa]ria", "Lei Geral Tributária"),
    (r"\blgt\b", "Lei Geral Tributária"),
    (r"regulamento\s*(?:das\s*)?custas\s*processuais", "Regulamento das Custas Processuais"),
    (r"\brcp\b", "Regulamento das Custas Processuais"),
    (r"\bnrau\b", "NRAU"),
    (r"\brjue\b", "RJUE"),
    (r"\blei\s*(?:n[.º°]?\s*)?(\d+[/-]\d+)", "Lei n.º #"),
    (r"\bdecreto[- ]lei\s*(?:n[.º°]?\s*)?(\d+[/-]\d+)", "Decreto-Lei n.º #"),
    (r"\bdl\s*(?:n[.º°]?\s*)?(\d+[/-]\d+)", "Decreto-Lei n.º #"),
]
UNNAMED = "Diploma não especificado"
ARTICLE = re.compile(r"art(?:igo)?[.º°]?\s*(\d+)\.?[º°]?(?:-([A-Z]))?", re.IGNORECASE)
NUMBER = re.compile(r"\bn\.?[º°]?\s*(\d+)")
CLAUSE = re.compile(r"al[ií]nea\s*([a-z])\)?|al\.\s*([a-z])\)?")
# What a citation in running text looks like, in order.
CITED = [
    re.compile(x, re.IGNORECASE)
    for x in (
        r"art(?:igo)?[.º°]?\s*\d+\.?[º°]?(?:-[A-Z])?(?:[,\s]+(?:n\.?[º°]?\s*\d+|al[ií]nea\s*[a-z]\)?))*[,\s]*(?:(?:do|da|dos|das)\s+)?(?:[^\n.;]{0,80})(?=\.|;|\n|$)",
        r"art(?:igo)?[.º°]?\s*\d+\.?[º°]?(?:-[A-Z])?\s*(?:,\s*n\.?[º°]?\s*\d+)?\s+(?:CC|CPC|CPP|CP|CT|CRP|NRAU|CIRS|CIRC|CIVA|RJUE|CSC|CPA|CPTA|CPPT|CCP|CVM|CIRE|CE|LGT|RCP)\b",
        r"(?:código|lei|decreto|regulamento)[^,.\n]{0,100}art(?:igo)?[.º°]?\s*\d+",
    )
]


class FirstInOrder:
    """Which of some patterns, by their order, a text matches first, and where it does so first."""

    def __init__(self, patterns: list[str]):
        self.any = re.compile("|".join(f"({p})" for p in patterns))
        groups, self.number = 1, {}
        for i, p in enumerate(patterns):
            self.number[groups] = i
            groups += 1 + re.compile(p).groups

    def search(self, text: str) -> tuple[int, re.Match] | None:
        best, m = None, self.any.search(text)
        while m:
            i = self.number[m.lastindex]
            if best is None or i < best[0]:
                best = i, m
            m = self.any.search(text, m.start() + 1) if best[0] else None
        return best


_laws = FirstInOrder([p for p, _ in LAWS])


def law(text: str) -> str | None:
    """The name of the law that a citation is of."""
    found = _laws.search(text.lower().strip())
    if not found:
        return None
    i, m = found
    inner = m[m.lastindex + 1] if "#" in LAWS[i][1] else ""
    return LAWS[i][1].replace("#", inner)


def normalised(text: str) -> tuple[str, str, str | None, str | None, str] | None:
    """(law, article, number, clause, all of these as one text) of a citation; None without an article."""
    article = ARTICLE.search(text)
    if not article:
        return None
    low = text.lower().strip()
    name = law(text) or UNNAMED
    shown = f"{article[1]}º" + (f"-{article[2].upper()}" if article[2] else "")
    number, clause = NUMBER.search(low), CLAUSE.search(low)
    n = number[1] if number else None
    c = (clause[1] or clause[2]) + ")" if clause else None
    return name, shown, n, c, f"{name}, artigo {shown}" + (f", n.º {n}" if n else "") + (f", alínea {c}" if c else "")


def extracted(text: str) -> Iterator[tuple]:
    """(excerpt, law, article, number, clause, normalised) of each different excerpt that one of CITED matches, pattern
    by pattern."""
    seen = set()
    for pattern in CITED:
        for m in pattern.finditer(text):
            excerpt = m[0].strip()
            if excerpt not in seen:
                seen.add(excerpt)
                found = normalised(excerpt)
                if found:
                    yield excerpt, *found
