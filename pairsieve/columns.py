"""Column names of the comparator's pair table.

Fixed values: these names come from the comparator's export and have to match it.
"""

SCORE = "nota final"
LEFT, RIGHT, STEP, LABEL, TARGET = "COMPREC", "REFREC", "PASSO", "PAR", "TARGET"
OUTCOME = "C_SITUENCE"

NAME_SCORES = [
    "NOME prim frag igual",
    "NOME ult frag igual",
    "NOME qtd frag iguais",
    "NOME qtd frag raros",
    "NOME qtd frag comuns",
    "NOME qtd frag muito parec",
    "NOME qtd frag abrev",
]
MOTHER_SCORES = [
    "NOMEMAE prim frag igual",
    "NOMEMAE ult frag igual",
    "NOMEMAE qtd frag iguais",
    "NOMEMAE qtd frag raros",
    "NOMEMAE qtd frag comuns",
    "NOMEMAE qtd frag muito parec",
    "NOMEMAE qtd frag abrev",
]
BIRTH_SCORES = [
    "DTNASC dt iguais",
    "DTNASC dt ap 1digi",
    "DTNASC dt inv dia",
    "DTNASC dt inv mes",
    "DTNASC dt inv ano",
]
TOWN_SCORES = ["CODMUNRES uf igual", "CODMUNRES local igual", "CODMUNRES local prox"]
ADDRESS_SCORES = [
    "ENDERECO via igual",
    "ENDERECO via prox",
    "ENDERECO numero igual",
    "ENDERECO compl prox",
    "ENDERECO texto prox",
    "ENDERECO tokens jacc",
]
SUB_SCORES = NAME_SCORES + MOTHER_SCORES + BIRTH_SCORES + TOWN_SCORES + ADDRESS_SCORES
ALL_SCORES = SUB_SCORES + [SCORE]

NAME_FIRST, NAME_LAST, NAME_COUNT = NAME_SCORES[:3]
NAME_SIMILAR = "NOME qtd frag muito parec"
NAME_BOTH = "NOME prim ult frag igual"
MOTHER_FIRST, MOTHER_LAST, MOTHER_COUNT = MOTHER_SCORES[:3]
MOTHER_BOTH = "NOMEMAE prim ult frag igual"
BIRTH_EQUAL, BIRTH_ONE_DIGIT, BIRTH_DAY_SWAP, BIRTH_MONTH_SWAP, BIRTH_YEAR_SWAP = BIRTH_SCORES
BIRTH_PARTS = ["DTNASC ano igual", "DTNASC mes igual", "DTNASC dia igual"]
TOWN_STATE, TOWN_EQUAL, TOWN_NEAR = TOWN_SCORES
STREET_EQUAL, STREET_NEAR = ADDRESS_SCORES[:2]
STREET_TEXT = "ENDERECO texto prox"

PREFIXED = [LEFT, RIGHT, "R_DTNASC", "C_DTNASC", "R_DTOBITO", "C_DTDIAG"]
