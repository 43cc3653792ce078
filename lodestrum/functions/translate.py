"""Spanish queries as English ones, by a dictionary and two rules of word order."""

from __future__ import annotations

import re

from lodestrum.functions.text import py_fold

#: Our own vocabulary: nouns, then adjectives. Keys are without accents.
NOUNS = dict(p.split(":") for p in "agua:water golpe:hit impacto:impact puerta:door viento:wind lluvia:rain trueno:thunder fuego:fire paso:footstep perro:dog gato:cat pajaro:bird coche:car motor:engine tren:train avion:plane arma:weapon disparo:gunshot explosion:explosion cristal:glass metal:metal madera:wood piedra:stone arena:sand papel:paper plastico:plastic voz:voice grito:scream risa:laugh multitud:crowd ciudad:city bosque:forest mar:sea rio:river campana:bell reloj:clock telefono:phone boton:button teclado:keyboard musica:music tambor:drum guitarra:guitar noche:night cocina:kitchen calle:street casa:house llave:key caja:box cuerda:rope cadena:chain espada:sword monstruo:monster robot:robot maquina:machine ascensor:elevator escalera:stairs hielo:ice nieve:snow hoja:leaf bola:ball anillo:ring tornillo:bolt varilla:rod engranaje:gear".split())
ADJECTIVES = dict(p.split(":") for p in "fuerte:loud suave:soft rapido:fast lento:slow grande:big pequeno:small pesado:heavy ligero:light oscuro:dark profundo:deep agudo:sharp grave:low seco:dry mojado:wet viejo:old nuevo:new rojo:red azul:blue verde:green negro:black blanco:white metalico:metallic electrico:electric mecanico:mechanical magico:magic lejano:distant cercano:close".split())
#: Fixed values of the language: words that go, and those that turn the order round.
DROPPED, LINKS = set("el la los las un una unos unas y con en por para al".split()), {"de", "del"}


def look_up(word: str) -> tuple[str, bool] | None:
    """English and whether it's an adjective: as it is, in the singular, in the masculine."""
    tries = [word]
    tries += [word[:-2]] if word.endswith("es") else []
    tries += [word[:-1]] if word.endswith("s") else []
    tries += [t[:-1] + "o" for t in list(tries) if t.endswith("a")]
    for t in tries:
        if t in NOUNS:
            return NOUNS[t], False
        if t in ADJECTIVES:
            return ADJECTIVES[t], True
    return None


def translate(query: str) -> tuple[str, bool]:
    """The query in English, and whether anything was translated. Unknown words stay."""
    words = re.findall(r"[^\W_]+", py_fold(query.lower()))
    found = [(w, look_up(w)) for w in words]
    if not any(hit for _, hit in found):
        return query, False
    phrases: list[list[str]] = [[]]
    for w, hit in found:
        if w in LINKS:
            phrases.append([])
        elif w in DROPPED and hit is None:
            continue
        elif hit and hit[1] and phrases[-1]:  # an adjective after its noun comes before it
            phrases[-1].insert(len(phrases[-1]) - 1, hit[0])
        else:
            phrases[-1].append(hit[0] if hit else w)
    return " ".join(w for p in reversed(phrases) for w in p), True
