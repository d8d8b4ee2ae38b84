"""Word lists, patterns and constants that decide results.

Everything here must stay exactly as it is for results to agree with earlier ones.
Callers may pass their own values wherever a function takes one of these as a default.
"""

# ---------------------------------------------------------------- fixed values: reading cells
MISSING_MARKERS = [
    "n/d", "nd", "n/a", "na", "s/i", "si", "-", "--", "—", "sem dado", "sem dados",
    "não informado", "nao informado", "null", "nan",
]
BOOLEAN_WORDS = ["sim", "não", "nao", "true", "false", "yes", "no", "s", "n"]
MONTH_WORDS = [
    "janeiro", "fevereiro", "março", "marco", "abril", "maio", "junho", "julho", "agosto",
    "setembro", "outubro", "novembro", "dezembro",
    "jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez",
]
NUMBER_WRAPPING = r"(?s)^(?:R\$\s*)?(?:US\$\s*)?(.*?)%?$"
NUMBER_CHARACTERS = r"^-?\d[\d.,]*$"
NUMBER_DOT_THOUSANDS_COMMA = r"^-?\d{1,3}(\.\d{3})+,\d+$"
NUMBER_COMMA_THOUSANDS_DOT = r"^-?\d{1,3}(,\d{3})+\.\d+$"
NUMBER_DOT_THOUSANDS = r"^-?\d{1,3}(\.\d{3})+$"
NUMBER_COMMA_THOUSANDS = r"^-?\d{1,3}(,\d{3})+$"
NUMBER_COMMA_DECIMAL = r"^-?\d+,\d+$"
NUMBER_SHORT_COMMA_DECIMAL = r"^-?\d+,\d{1,2}$"
NUMBER_ONE_DOT_GROUP = r"^-?\d{1,3}\.\d{3}$"
NUMBER_PLAIN = r"^-?\d+(\.\d+)?$"
NUMBER_LOOK = r"^(R\$\s*|US\$\s*)?-?[\d.,]+\s*%?$"
DATE_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{2,4})$"
DATE_ISO_START = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?"
YEAR_VALUE = r"^(19|20)\d{2}$"
LEADING_ZERO_VALUE = r"^0\d+$"

# ---------------------------------------------------------------- fixed values: column names
YEAR_NAME = r"(?iu)^(ano|anos|year|exerc[ií]cio)$"
LATITUDE_NAME = r"^(lat|latitude)$"
LONGITUDE_NAME = r"^(lon|lng|long|longitude)$"
NUMERIC_ID_NAME = r"(^id$|^id[_ ]|código|codigo|cod\b|\bid$)"
CODE_NAME = (
    r"(?iu)(^|[\s_.-])(cep|cpf|cnpj|rg|telefone|fone|celular|matr[ií]cula|ibge|c[oó]digo|cod|id|sku|ean|gtin"
    r"|pedido|protocolo|processo|inscri[cç][aã]o|nf|nfe)($|[\s_.-])"
)
COORDINATE_NAME = r"(?iu)(^|[\s_.-])(lat|latitude|lon|lng|long|longitude)($|[\s_.-])"
PERCENT_NAME = r"(?iu)(%|percentual|porcentagem|propor[cç][aã]o|taxa|[ií]ndice|cobertura|raz[aã]o)"
CURRENCY_NAME = r"(?iu)(valor|pre[cç]o|custo|receita|faturamento|sal[aá]rio|despesa|r\$)"
COUNT_NAME = r"(?iu)(qtd|quant|total|n[úu]mero de|casos|[óo]bitos|nascidos|habitantes|popula[cç][aã]o)"
RATE_NAME = r"(?iu)índice|indice|taxa|cobertura|propor[cç][ãa]o|percentual|%"
CURRENCY_VALUE = r"^(R\$|US\$)"
LATITUDE_WORDS = ["lat", "latitude"]
LONGITUDE_WORDS = ["lon", "lng", "long", "longitude"]
PERIOD_LINE = r"(?iu)^(m[eê]s|per[ií]odo|semana|ano|trimestre|compet[eê]ncia|data)\s*[:\-–]?\s+(.+)$"
HEADER_SPELLINGS = {
    "municipio": "Município", "periodo": "Período", "mes": "Mês",
    "regiao": "Região", "unidade": "Unidade", "estado": "Estado",
}
SMALL_WORDS = [
    "de", "da", "do", "dos", "das", "e", "com", "em", "para", "no", "na", "nos", "nas", "a", "o", "por", "ao",
]
NO_VALUE = "∅"

# ---------------------------------------------------------------- fixed values: thresholds
NUMBER_SHARE = 0.8
DATE_SHARE = 0.9
PERCENT_SHARE = 0.8
ID_SHARE = 0.95
LEADING_ZERO_SHARE = 0.5
MISSING_ALERT_SHARE = 0.3
HEADER_SHARE = 0.6
CATEGORY_SHARE = 0.05
CATEGORY_FLOOR = 20
CATEGORY_CEILING = 60
RELATION_ABS_TOLERANCE = 0.1
RELATION_REL_TOLERANCE = 0.005
METRES_PER_DEGREE = 111_000.0
DUPLICATE_METRES = 25.0

# ---------------------------------------------------------------- fixed values: survey records
RECORD_TYPES = ["localidade", "visita", "captura", "pit", "area", "rota", "outro"]
SEARCH_RESULTS = ["com_captura", "sem_captura", "nao_informado"]
EXAM_RESULTS = ["positivo", "negativo", "pendente", "nao_realizado", "nao_informado"]
CHANNELS = ["captura", "pit"]
ENVIRONMENTS = ["intra", "peri", "intra_peri"]
NOT_INFORMED = "nao_informado"
UNIDENTIFIED = "Não identificada"
NO_LOCALITY = "(sem localidade)"
EXAM_WORDS = {
    "positivo": ["positivo", "pos", "p", "positiva", "sim", "reagente", "infectado", "tc", "positive"],
    "negativo": ["negativo", "neg", "n", "negativa", "nao", "nao_reagente", "nao_infectado", "negative"],
    "pendente": ["pendente", "aguardando", "em_analise", "aguardando_resultado", "em_exame"],
    "nao_realizado": ["nao_realizado", "nao_realizada", "sem_exame", "nr", "nao_examinado", "nao_foi_examinado"],
    "nao_informado": ["nao_informado", "ni", "sem_informacao", "ignorado"],
}
SEARCH_WORDS = {
    "com_captura": [
        "com_captura", "capturado", "capturados", "positiva", "positivo", "sim", "houve_captura",
        "com_triatomineo", "com_triatomineos",
    ],
    "sem_captura": [
        "sem_captura", "nao_capturado", "negativa", "negativo", "nao", "sem_triatomineo",
        "sem_triatomineos", "nenhuma_captura",
    ],
    "nao_informado": ["nao_informado", "ni", "sem_informacao", "ignorado"],
}
SPECIES_PATTERNS = [
    (r"brasil+ie?nsis|brasilensis", "Triatoma brasiliensis"),
    (r"lutzi", "Panstrongylus lutzi"),
    (r"pseudomaculata", "Triatoma pseudomaculata"),
    (r"r[h]?odnius", "Rhodnius sp."),
]
FIELD_ALIASES = {
    "localidade": ["localidade", "nome_localidade", "comunidade", "povoado", "sitio", "distrito", "local", "bairro"],
    "data_visita": [
        "data_de_captura", "data", "data_visita", "data_da_visita", "dt_visita", "data_captura",
        "data_da_captura", "dt_captura", "data_busca",
    ],
    "data_exame": ["data_exame", "data_do_exame", "dt_exame", "data_resultado", "data_laudo"],
    "resultado_busca": [
        "resultado_busca", "resultado_da_busca", "situacao_busca", "busca", "houve_captura",
        "captura_realizada", "captura",
    ],
    "resultado_exame": [
        "resultado_do_exame_a_fresco", "resultado_exame_a_fresco", "resultado_exame", "resultado_do_exame",
        "exame", "resultado", "positividade", "t_cruzi", "infeccao", "resultado_laboratorio",
    ],
    "quantidade": [
        "quantidade", "qtd", "qtde", "n_triatomineos", "numero_de_triatomineos", "exemplares", "total_triatomineos",
    ],
    "fase": ["fase", "estagio", "estadio"],
    "sexo": ["sexo"],
    "especie": ["especie", "especie_triatomineo"],
    "endereco": ["endereco_completo", "endereco", "logradouro", "rua"],
    "imovel": [
        "numero_da_residencia", "numero_residencia", "residencia", "imovel", "numero_imovel", "n_imovel",
        "codigo_imovel", "cod_imovel",
    ],
    "pit": ["nome_do_pit", "pit", "codigo_pit", "cod_pit", "numero_pit"],
    "id_origem": [
        "n_da_etiqueta", "numero_da_etiqueta", "etiqueta", "id", "codigo", "cod", "identificador",
        "id_registro", "id_origem",
    ],
    "canal": ["campanha_captura_ou_pit", "captura_ou_pit", "campanha", "origem_captura"],
    "ambiente": ["intra_ou_peri", "ambiente", "local_captura"],
    "fase_sexo": ["ninfa_macho_ou_femea", "fase_sexo", "ninfa_macho_femea"],
    "qtd_imoveis": ["quantidade_de_imoveis", "qtd_imoveis", "numero_de_imoveis", "total_de_imoveis"],
    "zona": ["zona", "zona_pit"],
}
IGNORED_FIELDS = [
    "descricao", "latitude", "longitude", "estado_uf", "municipio", "cep", "ponto_de_referencia",
    "cod_da_localidade", "nome",
]
PERSONAL_FIELDS = [
    "morador", "nome_morador", "proprietario", "responsavel", "telefone", "celular", "cpf", "rg", "email",
    "nome_do_morador", "contato",
]
FOLDER_TYPE_PATTERNS = [
    (r"\bpits?\b", "pit"),
    (r"captur|coleta|resultado|positiv|negativ", "captura"),
    (r"visita|busca|pesquisa", "visita"),
    (r"rota|trajeto|percurso", "rota"),
    (r"localidade|comunidade|povoado|sitio", "localidade"),
    (r"area|poligono|limite|municipio", "area"),
]
TYPE_FOLDER = (
    r"\bpits?\b|captur|coleta|resultado|positiv|negativ|visita|busca|pesquisa|rota|trajeto|percurso"
    r"|^localidades?\b|^comunidades?$|^areas?\b|^poligonos?$|^pontos?$"
)
BOUNDARY_NAME = r"(^|\s)(limite|municipio|municipal|contorno)(\s|$)"
END_MARK = r"(?:in\S{0,3}cio|inicial|incial|final)(?:\s*[/\\-]\s*(?:in\S{0,3}cio|inicial|incial|final))?"
CODE_AND_MARK_AT_END = r"(?iu)\s*\b(?:c[oó]d\.?\s*)?\d{2,6}\s*(?:" + END_MARK + r")?\s*$"
MARK_AT_END = r"(?iu)\s*\b" + END_MARK + r"\s*$"
NUMBERED_MARK = r"(?iu)\b\d{2,6}\s*" + END_MARK + r"\s*$"
CODED_NAME = r"(?iu)\bc[oó]d\.?\s*\d{2,6}\b"
PLAUSIBLE_BOX = {"min_lon": -75.0, "max_lon": -30.0, "min_lat": -35.0, "max_lat": 6.0}
LAG_BUCKETS = [
    ("Exame antes da captura (conferir)", None, -1),
    ("0 a 7 dias", 0, 7),
    ("8 a 14 dias", 8, 14),
    ("15 a 21 dias", 15, 21),
    ("22 a 28 dias", 22, 28),
    ("29 a 35 dias", 29, 35),
    ("Mais de 35 dias", 36, None),
]
EXPORT_LABELS = {
    "com_captura": "Com captura", "sem_captura": "Sem captura", "nao_informado": "Não informado",
    "positivo": "Positivo", "negativo": "Negativo", "pendente": "Pendente", "nao_realizado": "Não realizado",
    "visita": "Visita", "captura": "Captura", "pit": "PIT", "arquivo": "Arquivo KML/KMZ", "manual": "Registro manual",
}
EXPORT_ENVIRONMENTS = {
    "intra": "Intradomicílio", "peri": "Peridomicílio", "intra_peri": "Intra e peridomicílio",
}
EXPORT_CHANNELS = {"pit": "PIT", "captura": "Captura em campanha"}
KML_EXAM_LABELS = {
    "positivo": "Positivo", "negativo": "Negativo", "pendente": "Pendente", "nao_realizado": "Não realizado",
}
KML_ENVIRONMENT_LABELS = {"intra": "Intra", "peri": "Peri", "intra_peri": "Intra e Peri"}

# Rows, block ends and lines of HTML descriptions, and the entities in them
DESCRIPTION_ROW = r"(?is)<tr[^>]*>\s*<t[dh][^>]*>(.*?)</t[dh]>\s*<t[dh][^>]*>(.*?)</t[dh]>"
DESCRIPTION_BLOCK_END = r"(?i)</(p|div|tr|li|h[1-6]|table)>|<br\s*/?>"
DESCRIPTION_LINE = r"^\s*([^:=\n]{2,40})\s*[:=]\s*(.+?)\s*$"
HTML_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")]
