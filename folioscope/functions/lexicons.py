"""Word lists. They are data of the measures, in the order in which they are published; any caller can pass others."""

#: Phrases that weigh much.
STRONG = (
    "стоит отметить",
    "важно отметить",
    "важно подчеркнуть",
    "следует отметить",
    "необходимо подчеркнуть",
    "необходимо отметить",
    "нельзя не отметить",
    "в современном мире",
    "в условиях современной",
    "в эпоху стремительного",
    "в настоящее время всё большую актуальность",
    "давайте рассмотрим",
    "как мы можем видеть",
    "благодаря развитию информационных технологий",
    "в рамках современной парадигмы",
    "в последние годы наблюдается тенденция",
    "многие исследователи отмечают",
    "интересно, что",
    "примечательно, что",
    "в этом разделе мы",
    "как было сказано выше",
    "как упоминалось ранее",
    "стоит подчеркнуть, что",
    "хотелось бы отметить",
    "позволяет обеспечить",
    "играет определяющую роль",
    "обеспечивает эффективность",
    "особое значение приобретает",
    "служит основой для",
    "представляется актуальной",
)

#: Phrases that weigh less.
MEDIUM = (
    "в свою очередь",
    "вместе с тем",
    "в то же время",
    "таким образом",
    "в рамках настоящей работы",
    "на сегодняшний день",
    "существует множество",
    "существует ряд",
    "широко распространено мнение",
    "играет важную роль",
    "обладает рядом преимуществ",
    "современные технологии позволяют",
    "рассматриваемый подход",
    "позволяет значительно оптимизировать",
    "в заключение стоит",
    "подводя итог",
    "в условиях цифровой трансформации",
    "представляет собой важный",
    "реализуется посредством",
)

#: Phrases of an author's stance.
ANCHORS = (
    "в рассматриваемом контексте",
    "данное соображение учитывалось",
    "необходимо оговориться",
    "при всех оговорках",
    "если следовать данной логике",
    "с точки зрения практической",
    "с учётом сказанного",
    "с позиции научной",
    "представляется небеспочвенным",
)

#: Words used too much.
OVERUSED = ("ключевой", "важный", "значительный", "существенный", "комплексный", "эффективный", "инновационный", "актуальный", "современный", "системный", "оптимальный", "уникальный", "универсальный")

#: Labels and forms of personal pronouns.
PRONOUNS = (("я", "я"), ("мне", "мне"), ("меня", "меня"), ("мной", "мно(?:й|ю)"), ("мы", "мы"), ("нас", "нас"), ("нам", "нам"), ("нами", "нами"), ("наш", "наш(?:а|е|и|его|ему|ей|ем|им|ими|их|у)?"))

#: Stems of short passive participles.
PASSIVE_STEMS = (
    "проведен", "получен", "выявлен", "установлен", "реализован", "рассмотрен", "выполнен", "построен", "определен", "изучен", "разработан", "предложен", "применен", "внедрен",
    "описан", "представлен", "приведен", "рассчитан", "сформулирован", "обоснован", "апробирован", "достигнут", "отражен", "использован", "создан", "сделан", "проанализирован",
)
