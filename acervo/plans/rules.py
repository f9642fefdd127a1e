"""The rule base of the classifier and the names of the months."""

from __future__ import annotations

# Category, and its terms with their weights, in order.
RULES = (
    ("conta_luz", (("kwh", 3), ("energia eletrica", 3), ("consumo", 1), ("distribuidora", 2))),
    ("conta_agua", (("m3", 2), ("agua", 2), ("saneamento", 3), ("hidrometro", 3))),
    ("nota_fiscal", (("nota fiscal", 4), ("nfe", 3), ("cnpj", 1), ("danfe", 4), ("total", 1))),
    ("boleto", (("boleto", 4), ("codigo de barras", 3), ("vencimento", 2), ("cedente", 3))),
    ("contrato", (("contrato", 4), ("clausula", 3), ("contratante", 3), ("partes", 1))),
    ("comprovante", (("comprovante", 4), ("transferencia", 2), ("pix", 2), ("pagamento", 1))),
    ("documento_pessoal", (("cpf", 2), ("rg", 2), ("identidade", 3), ("cnh", 3))),
)
DEFAULT = "outros"

# Months, in order.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")

# Extensions that are watched by default, and those each reader takes.
WATCHED = (".pdf", ".png", ".jpg", ".jpeg", ".txt")
TEXT_EXTENSIONS = (".txt", ".md", ".csv")
IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tiff", ".bmp")

# Reasons for ignoring a file.
NOT_WATCHED, INDEXED, UNSUPPORTED = "extensao nao monitorada", "ja indexado", "formato nao suportado: "
NO_PDF = "pypdf nao instalado (pip install pypdf)"
NO_OCR = "OCR indisponivel (pip install pytesseract Pillow + Tesseract no sistema)"
