"""A Portuguese stemmer after Orengo and Huyck (2001): suffix steps in the published order."""

from __future__ import annotations

# Fixed values: (suffix, least length of the stem, replacement, exceptions).
PLURAL = (
    ("ns", 1, "m", ()), ("ões", 3, "ão", ()), ("ães", 1, "ão", ("mães",)), ("ais", 1, "al", ("cais", "mais")), ("éis", 2, "el", ()), ("eis", 2, "el", ()),
    ("óis", 2, "ol", ()), ("is", 2, "il", ("lápis", "cais", "mais", "crúcis", "biquínis", "pois", "depois", "dois", "leis")), ("les", 3, "l", ()), ("res", 3, "r", ("árvores",)),
    ("s", 2, "", ("aliás", "pires", "lápis", "cais", "mais", "mas", "menos", "férias", "fezes", "pêsames", "crúcis", "gás", "atrás", "moisés", "através", "convés", "ês", "país", "após", "ambas", "ambos", "messias")),
)
FEMININE = (
    ("ona", 3, "ão", ("abandona", "lona", "iona", "cortisona", "monótona", "maratona", "acetona", "detona", "carona")), ("ora", 3, "or", ()), ("na", 4, "no", ("carona", "abandona", "lona", "iona", "campana", "grana", "caravana", "banana", "paisana")),
    ("inha", 3, "inho", ("rainha", "linha", "minha")), ("esa", 3, "ês", ("mesa", "obesa", "princesa", "turquesa", "ilesa", "pesa", "presa")), ("osa", 3, "oso", ("mucosa", "prosa")),
    ("íaca", 3, "íaco", ()), ("ica", 3, "ico", ("dica",)), ("ada", 2, "ado", ("pitada",)), ("ida", 3, "ido", ("vida",)), ("ída", 3, "ido", ("recaída", "saída", "dúvida")), ("ima", 3, "imo", ("vítima",)),
    ("iva", 3, "ivo", ("saliva", "oliva")), ("eira", 3, "eiro", ("beira", "cadeira", "frigideira", "bandeira", "feira", "capoeira", "barreira", "fronteira", "besteira", "poeira")), ("ã", 2, "ão", ("amanhã", "arapuã", "fã", "divã")),
)
ADVERB = (("mente", 4, "", ("experimente",)),)
AUGMENTATIVE = (
    ("ação", 3, "", ("equação", "relação")), ("ição", 3, "", ()),
    ("díssimo", 5, "", ()), ("abilíssimo", 5, "", ()), ("íssimo", 3, "", ()), ("ésimo", 3, "", ()), ("érrimo", 4, "", ()), ("zinho", 2, "", ()), ("quinho", 4, "c", ()), ("uinho", 4, "", ()), ("adinho", 3, "", ()),
    ("inho", 3, "", ("caminho", "cominho")), ("alhão", 4, "", ()), ("zão", 2, "", ("coalizão",)), ("ão", 3, "", tuple("camarão chimarrão canção coração embrião grotão glutão ficção fogão feição furacão gamão lampião leão macacão nação órfão orgão patrão portão quinhão rincão falcão espião mamão folião cordão aptidão campeão colchão limão leilão melão barão milhão bilhão cristão ilusão capitão estação senão".split())),
)
NOUN = (
    ("encialista", 4, "", ()), ("alista", 5, "", ()), ("agem", 3, "", ("coragem", "chantagem", "vantagem", "carruagem")), ("iamento", 4, "", ()), ("amento", 3, "", ("firmamento", "fundamento", "departamento")), ("imento", 3, "", ()), ("mento", 6, "", ("firmamento", "elemento", "complemento", "instrumento", "departamento")),
    ("alizado", 4, "", ()), ("atizado", 4, "", ()), ("izado", 5, "", ("organizado", "pulverizado")), ("ativo", 4, "", ("pejorativo", "relativo")), ("tivo", 4, "", ("relativo",)), ("ivo", 4, "", ("passivo", "possessivo", "pejorativo", "positivo")), ("ado", 2, "", ("grado",)), ("ido", 3, "", ("cândido", "consolido", "rápido", "decido", "tímido", "duvido", "marido")),
    ("ador", 3, "", ()), ("edor", 3, "", ()), ("idor", 4, "", ("ouvidor",)), ("dor", 4, "", ("ouvidor",)), ("sor", 4, "", ("assessor",)), ("atoria", 5, "", ()), ("tor", 3, "", ("benfeitor", "leitor", "editor", "pastor", "produtor", "promotor", "consultor")), ("or", 2, "", ("motor", "melhor", "redor", "rigor", "sensor", "tambor", "tumor", "assessor", "benfeitor", "pastor", "terior", "favor", "autor", "calor")),
    ("abilidade", 5, "", ()), ("icionista", 4, "", ()), ("cionista", 5, "", ()), ("ionista", 5, "", ()), ("idade", 4, "", ("autoridade", "comunidade")), ("ional", 4, "", ()), ("ência", 3, "", ()), ("ância", 4, "", ("ambulância",)), ("ura", 4, "", ("imatura", "acupuntura", "costura", "estatura")),
    ("ização", 5, "", ("concretização", "organização")), ("ação", 3, "", ("equação", "relação")), ("ção", 3, "", ("eleição", "tração", "indução")), ("são", 3, "", ("fusão", "ilusão", "tensão", "visão", "pressão")), ("ico", 4, "", ("tico", "público", "explico", "elétrico")), ("ante", 2, "", ("gigante", "elefante", "adiante", "possante", "instante", "restaurante")), ("ente", 4, "", ("freqüente", "alimente", "acrescente", "permanente", "oriente", "aparente")), ("eza", 3, "", ()), ("oso", 3, "", ("precioso",)), ("ista", 4, "", ()), ("ez", 4, "", ()),
    ("ático", 3, "", ()), ("ário", 3, "", ("voluntário", "salário", "aniversário", "diário", "lionário", "armário")), ("ério", 6, "", ()), ("eiro", 3, "", ("desfiladeiro", "pioneiro", "mosteiro")), ("ável", 2, "", ("afável", "razoável", "potável", "vulnerável")), ("ível", 3, "", ("possível",)), ("ncial", 4, "nc", ()), ("al", 4, "", ("afinal", "animal", "estatal", "bissexual", "desleal", "fiscal", "formal", "pessoal", "liberal", "postal", "virtual", "visual", "pontual", "sideral", "sucursal")), ("iz", 5, "", ()),
)
VERB = (
    ("aríamo", 2, ""), ("ássemo", 2, ""), ("eríamo", 2, ""), ("êssemo", 2, ""), ("iríamo", 3, ""), ("íssemo", 3, ""), ("áramo", 2, ""), ("aremo", 2, ""), ("ariam", 2, ""), ("assem", 2, ""), ("eremo", 3, ""), ("eriam", 3, ""), ("essem", 3, ""), ("iremo", 3, ""), ("iriam", 3, ""),
    ("ando", 2, ""), ("endo", 3, ""), ("indo", 3, ""), ("aram", 2, ""), ("arão", 2, ""), ("eram", 3, ""), ("erão", 3, ""), ("iram", 3, ""), ("avam", 2, ""), ("aria", 2, ""), ("asse", 2, ""), ("eria", 3, ""), ("esse", 3, ""), ("iria", 3, ""), ("ará", 2, ""), ("ava", 2, ""), ("ida", 3, ""), ("ara", 2, ""), ("era", 3, ""),
    ("ear", 4, ""), ("uei", 3, ""), ("ado", 2, ""), ("am", 2, ""), ("ar", 2, ""), ("em", 2, ""), ("er", 2, ""), ("eu", 3, ""), ("ia", 3, ""), ("ir", 3, ""), ("iu", 3, ""), ("ou", 3, ""), ("ei", 3, ""), ("i", 3, ""),
)
VOWEL = (("gue", 2, "g"), ("á", 2, ""), ("ê", 2, ""), ("a", 3, ""), ("e", 3, ""), ("o", 3, ""))


def _step(word: str, rules) -> tuple[str, bool]:
    for suffix, least, new, *exceptions in rules:
        if word.endswith(suffix) and len(word) - len(suffix) >= least and not (exceptions and word in exceptions[0]):
            return word[: len(word) - len(suffix)] + new, True
    return word, False


def stem(word: str) -> str:
    word = word.lower()
    if word.endswith("s"):
        word, _ = _step(word, PLURAL)
    if word.endswith(("a", "ã")):
        word, _ = _step(word, FEMININE)
    word, _ = _step(word, AUGMENTATIVE)
    word, _ = _step(word, ADVERB)
    word, done = _step(word, NOUN)
    if not done:
        word, done = _step(word, VERB)
        if not done:
            word, _ = _step(word, VOWEL)
    return word
