"""Fixed values shared by the library, kept in one place."""

from dataclasses import dataclass

# The classes in model-output order, and the texts of the record views.
CLASSES = ("Arenosa", "Media", "Siltosa", "Muito Argilosa", "Argilosa")
NO_ADDRESS = "Localização não disponível"
ADDRESS_LABEL = "Endereço não disponível"
CLASS_LABEL = "Não classificado"
COORDINATES_LABEL = "Coordenadas não disponíveis"
SHARE_TITLE = "Análise de solo"
DISCLAIMER = "Dicas de manejo consultivas, baseadas em fontes públicas. Não substituem avaliação técnica presencial."
LOCALE = "pt-BR"
BAND_LABELS = {"high": "Alta", "moderate": "Moderada", "low": "Baixa"}
HIGH, MODERATE = 0.80, 0.60
HISTORY_CAP = 150
MAX_ATTEMPTS = 3
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp")

# Luma weights and the fixed points of the photo metrics.
LUMA = (0.299, 0.587, 0.114)
DARK_CLIP, BRIGHT_CLIP = 2.0, 253.0
SPECULAR_LUMA, SPECULAR_SATURATION = 250.0, 0.10
BLUR_SIDE = 512
CRITERIA_ORDER = ("blur", "exposure", "clipping", "contrast", "colorCast", "specular", "resolution")
BLOCKING = ("blur", "exposure", "clipping", "resolution")


@dataclass(frozen=True)
class QualityCriteria:
    """Thresholds of the photo audit."""

    min_blur: float = 100.0
    min_luma: float = 40.0
    max_luma: float = 215.0
    max_clipped: float = 0.05
    min_contrast: float = 20.0
    max_cast: float = 0.15
    max_specular: float = 0.10
    min_side: int = 512
