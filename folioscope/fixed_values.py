"""Fixed values.

Everything here must equal what existing data and users of the job expect: word
lists, limits, markers, prompts, templates, identifiers. All of it is only a default;
every operator takes the value as a parameter.
"""

# --- fixed values: text filter -------------------------------------------------
TEXT_STOP_PHRASES = [
    "copyright", "isbn", "cdu", "universidade federal", "ministério da educação",
    "reitor", "coordenação", "diagramação", "ilustrações", "sumário", "bibliográficas",
]
MIN_TEXT_LENGTH = 50

# --- fixed values: image filter ------------------------------------------------
MIN_IMAGE_WIDTH = 100
MIN_IMAGE_HEIGHT = 100
MIN_GREY_STDDEV = 20.0

# --- fixed values: words a CSV reader takes for "no value" ---------------------
NULL_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- fixed values: markers in a model answer -----------------------------------
SUMMARY_MARKERS = ["RESUMO:", "DESCRIÇÃO:"]
KEYWORDS_MARKER = "PALAVRAS-CHAVE:"
MISSING_PART = "N/A"

# --- fixed values: prompts -----------------------------------------------------
TEXT_PROMPT = """
Você é um assistente especialista em biologia celular.
Analise o seguinte bloco de texto extraído de uma apostila de biologia.
1.  Faça um resumo conciso do conteúdo principal (2-3 sentenças).
2.  Gere uma lista de 5 a 10 palavras-chave ou termos de busca relevantes.
Responda em formato:
RESUMO: [Seu resumo aqui]
PALAVRAS-CHAVE: [palavra1, palavra2, ...]

TEXTO:
---
{}
---
"""
IMAGE_PROMPT = """
Você é um assistente especialista em biologia celular.
Analise esta imagem extraída de uma apostila de biologia.
1.  Descreva detalhadamente o que a imagem representa.
2.  Gere uma lista de 5 a 10 palavras-chave ou termos de busca relevantes.
Responda em formato:
DESCRIÇÃO: [Sua descrição aqui]
PALAVRAS-CHAVE: [palavra1, palavra2, ...]
"""

# --- fixed values: embedding text templates (description, keywords) -------------
TEMPLATE_TEXT = "Conteúdo sobre: {description}. Termos relacionados: {keywords}"
TEMPLATE_IMAGE = "Imagem mostrando: {description}. Termos relacionados: {keywords}"
TEMPLATE_UNIFIED = "Descrição: {description}. Palavras-chave: {keywords}"

# --- fixed values: encoder prefixes of the text specialist ----------------------
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "

# --- fixed values: encoders and vectors -----------------------------------------
TEXT_MODEL = "intfloat/multilingual-e5-large"
JOINT_MODEL = "openai/clip-vit-large-patch14"
JOINT_WIDTH = 768
VISUAL_WEIGHT = 0.4
TEXT_WEIGHT = 0.6

# --- fixed values: the four approaches ------------------------------------------
APPROACH_TEXT_ONLY = "approach_1_text_only"
APPROACH_HYBRID = "approach_2_hybrid_clip"
APPROACH_JOINT = "approach_3_pure_clip"
APPROACH_UNIFIED = "approach_4_unified_hybrid"

# --- fixed values: search --------------------------------------------------------
TOP_K = 5
SNIPPET_WORDS = 40
LABEL_CHARS = 40
TEST_QUERIES = [
    "qual a função do retículo endoplasmático?", "diferenças entre célula animal e vegetal",
    "o que é a teoria da endossimbiose?", "estrutura e função dos lisossomos",
    "processo da mitose", "o que são células tronco?", "descrição do complexo de golgi",
    "metamorfose do girino", "o que é a membrana plasmática?", "como funciona a fagocitose?",
]

# --- fixed values: votes and rating records --------------------------------------
VOTE_RELEVANT = "relevante"
VOTE_NOT_RELEVANT = "nao_relevante"
RATING_VALUES = [1, 0]
PENDING = "Pendente"
NO_USER = "N/A"
PAGE_LABEL = "Página %d"
SCORE_LABEL = "Score: %.4f"
TYPE_LABELS = {"text": "Texto", "image": "Imagem"}
IMAGE_TAG_HEAD = '<img src="data:image/png;base64,'
IMAGE_TAG_TAIL = '" width="200">'
IMAGE_MISSING = "<i>Imagem não encontrada</i>"
IMAGE_CAPTION = "<br><br><b>Descrição:</b> "

# --- fixed values: profiling -------------------------------------------------------
DOMAIN_STOP_WORDS = [
    "imagem", "texto", "estrutura", "representa", "mostra", "descreve", "embora",
    "crucial", "diferença", "provavelmente", "processamento", "apenas", "demonstra",
    "possivelmente", "incluindo",
]
LENGTH_BINS = 40
PAGE_BINS = 24
TOP_PAGES = 15
TOP_NGRAMS = 20
TOP_WORDS = 200

# --- fixed values: Portuguese stop words, as Spark ships them -------------------------
PORTUGUESE_STOP_WORDS = [
    "de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "não", "uma", "os", "no", "se",
    "na", "por", "mais", "as", "dos", "como", "mas", "ao", "ele", "das", "à", "seu", "sua", "ou",
    "quando", "muito", "nos", "já", "eu", "também", "só", "pelo", "pela", "até", "isso", "ela", "entre",
    "depois", "sem", "mesmo", "aos", "seus", "quem", "nas", "me", "esse", "eles", "você", "essa", "num",
    "nem", "suas", "meu", "às", "minha", "numa", "pelos", "elas", "qual", "nós", "lhe", "deles",
    "essas", "esses", "pelas", "este", "dele", "tu", "te", "vocês", "vos", "lhes", "meus", "minhas",
    "teu", "tua", "teus", "tuas", "nosso", "nossa", "nossos", "nossas", "dela", "delas", "esta",
    "estes", "estas", "aquele", "aquela", "aqueles", "aquelas", "isto", "aquilo", "estou", "está",
    "estamos", "estão", "estive", "esteve", "estivemos", "estiveram", "estava", "estávamos", "estavam",
    "estivera", "estivéramos", "esteja", "estejamos", "estejam", "estivesse", "estivéssemos",
    "estivessem", "estiver", "estivermos", "estiverem", "hei", "há", "havemos", "hão", "houve",
    "houvemos", "houveram", "houvera", "houvéramos", "haja", "hajamos", "hajam", "houvesse",
    "houvéssemos", "houvessem", "houver", "houvermos", "houverem", "houverei", "houverá", "houveremos",
    "houverão", "houveria", "houveríamos", "houveriam", "sou", "somos", "são", "era", "éramos", "eram",
    "fui", "foi", "fomos", "foram", "fora", "fôramos", "seja", "sejamos", "sejam", "fosse", "fôssemos",
    "fossem", "for", "formos", "forem", "serei", "será", "seremos", "serão", "seria", "seríamos",
    "seriam", "tenho", "tem", "temos", "tém", "tinha", "tínhamos", "tinham", "tive", "teve", "tivemos",
    "tiveram", "tivera", "tivéramos", "tenha", "tenhamos", "tenham", "tivesse", "tivéssemos",
    "tivessem", "tiver", "tivermos", "tiverem", "terei", "terá", "teremos", "terão", "teria",
    "teríamos", "teriam",
]
