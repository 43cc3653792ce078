"""Labels of categories as people say them: "helicopter", "boat door", "metal impact", "antique vehicle", "interior rain".

A label is what is said of the subcategory with the category's noun before it, after it or not at all. Where the noun stands
is a table: by category, or else by subcategory, or else by how many categories share the subcategory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subcategories that say nothing, and categories that are materials, whose subcategories are actions.
GENERIC = ["GENERAL", "MISC", "MISCELLANEOUS", "OTHER"]
MATERIALS = ["CERAMICS", "CHAINS", "CLOTH", "DIRT & SAND", "GLASS", "ICE", "LEATHER", "LIQUID & MUD", "METAL", "PAPER", "PLASTIC", "ROCKS", "ROPE", "RUBBER", "SNOW", "WOOD"]
#: Subcategories that stand before the noun.
ADJECTIVES = [
    "ANTIQUE", "ELECTRIC", "ELECTRONIC", "MILITARY", "MODERN", "INDUSTRIAL", "DOMESTIC", "HITECH", "DESIGNED", "REAL", "COMMERCIAL", "RECREATIONAL",
    "TRADITIONAL", "AIR POWERED", "HIGH SPEED", "LARGE", "SMALL", "DIGITAL", "ANALOG", "MECHANICAL", "HYDRAULIC & PNEUMATIC", "PNEUMATIC", "TACTICAL", "EXPERIMENTAL",
    "ANGRY", "CHILDREN", "WILD", "AQUATIC", "AVIAN", "EVIL", "ANGELIC", "ELEMENTAL", "TONAL", "TURBULENT", "HUMAN", "ANIMAL", "CREATURE", "INSECT",
    "METAL", "WOOD", "GLASS", "PLASTIC", "STONE", "CONCRETE", "RUBBER", "CERAMIC", "COMPOSITE", "CLOTH", "HAND", "POWER", "GARDEN", "VIDEO", "BOARD", "INDOOR", "OUTDOOR",
]
#: Nouns of categories whose own name isn't one, and categories whose noun always goes along, before or after.
NOUNS = {
    "AIRCRAFT": "aircraft", "ALARMS": "alarm", "AMBIENCE": "ambience", "ANIMALS": "animal", "BEEPS": "beep", "BELLS": "bell", "BIRDS": "bird", "BOATS": "boat", "BULLETS": "bullet",
    "CARTOON": "cartoon", "CHAINS": "chain", "CHEMICALS": "chemical", "CLOCKS": "clock", "COMMUNICATIONS": "communications", "COMPUTERS": "computer", "CREATURES": "creature",
    "CROWDS": "crowd", "DOORS": "door", "DRAWERS": "drawer", "EXPLOSIONS": "explosion", "FIREWORKS": "firework", "FOOTSTEPS": "footsteps", "GAMES": "game", "GUNS": "gun", "HORNS": "horn",
    "LASERS": "laser", "MACHINES": "machine", "MOTORS": "motor", "OBJECTS": "object", "ROBOTS": "robot", "ROCKS": "rock", "SCIFI": "sci-fi", "SPORTS": "sports", "SWOOSHES": "swoosh",
    "TOOLS": "tool", "TOYS": "toy", "TRAINS": "train", "USER INTERFACE": "UI", "VEHICLES": "vehicle", "VOICES": "voice", "WEAPONS": "weapon", "WHISTLES": "whistle", "WINDOWS": "window",
    "WINGS": "wings", "CERAMICS": "ceramic",
}
NOUN_FIRST, NOUN_LAST = ["SCIFI", "CLOCKS", "LASERS"], ["TOOLS", "GAMES", "SPORTS", "MOVEMENT", "FOOTSTEPS", "WINGS", "CROWDS"]

BEFORE, AFTER = "before", "after"
#: Where the noun stands whatever the subcategory, by category.
BY_CATEGORY = dict.fromkeys([*MATERIALS, *NOUN_FIRST], BEFORE) | dict.fromkeys(NOUN_LAST, AFTER)
#: Words that follow their noun in a subcategory and precede it in a label.
TURNED = ["wild", "domestic"]


def said_words(text: Column) -> Column:
    """The words of a name in lower case; its signs for "and" and "or" are words too."""
    spelled = F.replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), F.lit("/"), F.lit(" or "))
    return F.regexp_extract_all(spelled, F.lit("[a-z0-9'-]+"), F.lit(0))


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def labelled(categories: DataFrame) -> DataFrame:
    """Categories (cat, sub) with their label; letters' case doesn't matter. A subcategory that several categories of the table
    share isn't said alone."""
    rows = categories.withColumns({"_c": F.upper("cat"), "_s": F.upper("sub")})
    shared = rows.groupBy("_s").agg((F.count_distinct("_c") > 1).alias("_shared"))
    rows = rows.join(shared, "_s", "left")
    own, words = said_words(F.col("cat")), said_words(F.col("sub"))
    turned = F.when((F.size(words) == 2) & F.get(words, F.lit(1)).isin(TURNED), F.reverse(words)).otherwise(words)
    noun = F.coalesce(_looked_up(NOUNS, F.col("_c")), F.array_join(own, " "))
    describes = F.col("_s").isin(ADJECTIVES)
    by_subcategory = F.when(describes, AFTER).when(F.col("_shared"), F.when(F.col("_c") == "AMBIENCE", AFTER).otherwise(BEFORE))
    place = F.coalesce(_looked_up(BY_CATEGORY, F.col("_c")), by_subcategory)
    said = F.array_join(turned, " ")
    usual = F.concat_ws(" ", F.when(place == BEFORE, noun), said, F.when(place == AFTER, noun))
    rain = F.when(F.col("_s") == "INTERIOR", "interior rain").otherwise(F.concat(F.lit("rain on "), said))
    label = F.when(F.col("_s").isin(GENERIC), F.array_join(own, " ")).when(F.col("_c") == "RAIN", rain).otherwise(usual)
    return rows.withColumn("label", label).drop("_c", "_s", "_shared")
