"""Fixed word lists and example sentences for tagging answers (English, German, French, Spanish)."""

# Frequent short words, by language.
STOP_WORDS = {
    "en": "the a an of to is are in and or what which when where how why does do can be by for with from on than that this it its i not will would should must there no any only before after as at if has have was were them so",
    "de": "der die das den dem des ein eine einen einem und oder ist sind wird werden wie was wann wo warum welche welchen kann können mit für von auf im in an zu nicht nur nach bevor ich es sich über aus bei sobald ohne zum zur auch mehr lässt hat mehrere dazu",
    "fr": "le la les l un une des du de d et ou est sont que qu quel quelle comment pourquoi où quand peut il elle on ce cette se ne pas pour dans par avec sur au aux avant après plus sans je si à en lorsque dès plusieurs mais jusqu",
    "es": "el la los las un una unos de del y o es son que qué cuál cómo cuándo dónde por para con sin en se si no puede hay antes después más entre su lo al cada solo desde esto esta varios pero tras cuando ya me",
}

# Words after which a sentence goes on.
OPEN_ENDS = (
    "the a an of to is are in and or which when because that than by for with from on as at its before into but if while through "
    "der die das den dem ein eine einen und oder ist wird weil mit für von auf im zu nach über aus bei an dass als wenn ohne zur zum aber sich "
    "le la les un une des du de et ou est que qui par pour dans avec sur au aux parce dont sans mais à en se si "
    "el la los las un una de del y o es que por para con en se porque sin al cuyo pero su cuando entre"
)

# What an answer consists of that is no answer at all.
PLACEHOLDERS = (
    "answer", "antwort", "réponse", "reponse", "respuesta", "n a", "na", "null", "none", "nil", "nan", "todo", "tbd", "fixme",
    "no output", "no answer", "empty", "placeholder", "undefined", "your answer here", "insert answer", "answer here", "pending", "xxx",
    "response", "output", "result", "no response", "no content", "no data", "a", "text", "lorem ipsum",
)

# Words of notes that stand where an answer is still to come: what is to come, and what may stand beside it.
FILLER_HEADS = (
    "answer response reply todo tbd tba tbc fixme placeholder pending lorem coming written filled provided soon later above below "
    "wip draft unanswered blank applicable available "
    "antwort folgt später siehe ausstehend platzhalter ergänzen nachgereicht offen entwurf "
    "réponse compléter venir rédiger attente ci-dessus "
    "respuesta completar pendiente próximamente redactar rellenar arriba"
)
FILLER_WORDS = (
    "a an the no not none yet to be is in here see your my this insert add put write fill out up enter text of for and content value it will "
    "noch keine kein hier zu die der wird wurde ist einfügen eintragen text nicht oben unten "
    "à la le une pas de aucune sans ici voir insérer texte encore en plus tard ne est "
    "por la el una sin aún no ver aquí insertar poner texto más de está todavía"
)

# Stems that refusals are made of, by what they express; words are matched whole.
CUES = {
    "speaker": "i|i'm|i'd|i'll|i've|my|me|we|ich|mir|mich|wir|uns|je|j|m|moi|nous|yo|mí|me|nosotros|assistant|hilfsprogramm|assistent|asistente|model|modell|modèle|modelo",
    "regret": "sorry|unfortunately|regret\\w*|afraid|apolog\\w*|pardon|leider|bedauer\\w*|leid|entschuldig\\w*|désolé\\w*|navré\\w*|malheureusement|regrette|excus\\w*|hélas|siento|lament\\w*|desgracia|disculp\\w*|perdón|desafortunad\\w*",
    "negation": "not|no|n't|can't|cannot|won't|don't|isn't|doesn't|couldn't|wouldn't|unable|nothing|none|without|neither|nor|nicht|nichts|kein\\w*|ohne|weder|ne|n|pas|aucun\\w*|rien|sans|impossible|ni|nada|ningun\\w*|ningún|sin|imposible",
    "reply": "answer\\w*|unanswered|reply|help\\w*|say|comment|respond\\w*|guess\\w*|tell|antwort\\w*|beantwort\\w*|helfe\\w*|weiterhelf\\w*|sage\\w*|auskunft|rate|répon\\w*|aider|prononcer|conclure|dire|respon\\w*|contest\\w*|ayudar|decir|opinar",
    "decline": "declin\\w*|refus\\w*|stopped|leave|rather|outside|beyond|rephrase|pass|withhold|abstain|offen|ablehn\\w*|lieber|reste|préfère|abstien\\w*|dépass\\w*|queda|fuera|prefiero|rechaz\\w*|abstengo|verzicht\\w*",
    "sources": "source\\w*|context|excerpts?|material|retrieved|given|evidence|details|usable|passages?|snippets?|documents?|documentation|quelle\\w*|auszüge\\w*|unterlagen|angaben|kontext|dokument\\w*|textstelle\\w*|vorlieg\\w*|extraits|éléments|contexte|fourni\\w*|fragmentos|fuentes?|datos|contexto|documentos?|útiles|utile|pasajes",
    "knowing": "information|knowledge|know\\w*|aware|familiar|certain\\w*|sure|verif\\w*|confirm\\w*|determin\\w*|conclu\\w*|establish\\w*|infer\\w*|speculat\\w*|verdict|opinion\\w*|judg\\w*|assum\\w*|claim\\w*|informationen|wissen|weiß|kenntnis\\w*|bekannt|bestätig\\w*|feststell\\w*|vermut\\w*|spekul\\w*|aussage\\w*|beurteil\\w*|entnehm\\w*|hervor|einschätz\\w*|information\\w*|savoir|sais|connais\\w*|sûr\\w*|affirm\\w*|détermin\\w*|trancher|suppos\\w*|spécul\\w*|avis|información|saber|sé|conoc\\w*|segur\\w*|afirm\\w*|especul\\w*|opini\\w*",
    "lack": "insufficien\\w*|inadequa\\w*|enough|lack\\w*|missing|limited|unclear|unknown|silent|absent|too|little|unzureichend\\w*|genug|genüg\\w*|ausreich\\w*|fehl\\w*|unklar|unbekannt|insuffisan\\w*|assez|manqu\\w*|suffi\\w*|inconnu\\w*|insuficien\\w*|suficiente\\w*|falta\\w*|desconoc\\w*|carezco",
    "propriety": "irresponsib\\w*|inappropriate|permitted|allowed|comfortable|discuss|able|capable|position|unverantwortlich|befugt|darf|imstande|lage|irresponsable|autorisé\\w*|mesure|imprudent\\w*|compétence\\w*|capaz|condiciones|permitid\\w*|corresponde|competencia\\w*",
    "redirect": "ask|consult|refer|contact|maintainers?|please|expert|bitte|fragen|wenden|betreuer|entwickler|demandez|adress\\w*|consult\\w*|mainteneur\\w*|pregunt\\w*|dirija\\w*|mantenedores",
}

# Sentences of other languages, so that some of what isn't known is seen.
OTHER_LANGUAGES = (
    "Il programma legge ogni riga del file e scrive il risultato nella tabella.", "Se il valore non è impostato, il processo attende la prossima esecuzione.", "Ogni nodo conserva una copia della propria configurazione per sicurezza.",
    "Het programma leest elke regel van het bestand en schrijft het resultaat weg.", "Als de waarde niet is ingesteld, wacht het proces op de volgende keer.", "Elke knoop bewaart een eigen kopie van zijn instellingen.",
    "O programa lê cada linha do arquivo e grava o resultado na tabela.", "Se o valor não estiver definido, o processo espera pela próxima execução.", "Cada nó guarda uma cópia da sua própria configuração.",
    "Programmet læser hver linje i filen og skriver resultatet i tabellen.", "Hvis værdien ikke er sat, venter processen på næste kørsel.", "Hver knude gemmer sin egen kopi af indstillingerne.",
    "Program čte každý řádek souboru a výsledek zapisuje do tabulky.", "Pokud hodnota není nastavena, proces čeká na další spuštění.", "Každý uzel si uchovává vlastní kopii nastavení.",
    "A program beolvassa a fájl minden sorát, és az eredményt a táblába írja.", "Ha az érték nincs beállítva, a folyamat a következő futásra vár.", "Minden csomópont megőrzi a beállítások saját másolatát.",
    "Программа читает каждую строку файла и пишет результат в таблицу.", "Если значение не задано, процесс ждёт следующего запуска.",
    "Το πρόγραμμα διαβάζει κάθε γραμμή του αρχείου και γράφει το αποτέλεσμα.", "程序读取文件的每一行并把结果写入表中。", "如果没有设置该值,进程会等待下一次运行。",
    "プログラムはファイルの各行を読み込み、結果を表に書き込みます。", "프로그램은 파일의 각 줄을 읽고 결과를 표에 기록합니다.", "प्रोग्राम फ़ाइल की हर पंक्ति पढ़ता है और परिणाम तालिका में लिखता है।",
)

# Question, answer and refusal examples that every training set has, whatever the data.
EXAMPLES = {
    "en": {
        "questions": ["Which option sets the size of the cache?", "How does the loader find its files?", "What is the default value of `max_items`?"],
        "answers": [
            "The loader reads every file below the root.", "Set `max_items` to 40 when the cache is small.", "Each worker keeps its own copy of the table.",
            "If the table is empty, the reader waits for the next run.", "The value of `max_items` is checked before the start.",
        ],
        "refusals": [
            "I can't answer this", "I cannot answer that question", "I am not able to help with that", "I have to decline this one", "I won't be able to say",
            "I do not have enough material to reply", "The context I was given does not say", "There is nothing in the given files that would let me answer",
            "No source I can see covers this, so I will leave it open", "I'd rather not guess about {x}", "That is outside what I will comment on",
            "No answer is possible from the retrieved files", "Please rephrase or add context; as it stands this stays unanswered",
            "Generation stopped: nothing usable was retrieved for {x}", "The excerpts do not contain the answer", "I don't know the answer to this",
            "None of the sources helps with this question", "This question stays open for lack of sources",
            "The material says too little about {x} to settle this", "I know nothing about {x}", "This is not covered by any document I was shown", "I lack the information to decide", "What was given is not sufficient for a reliable reply", "Nobody could conclude that from these snippets", "I would have to invent something about {x}, and I will not", "I am not in a position to judge {x}", "No statement about {x} can be made from the documents", "Whether this holds is unclear to me, so I abstain", "The documentation at hand is silent on {x}", "Please contact the team behind {x}, I have no knowledge of it", "It is not possible to verify this here", "I must withhold an answer, too little is known about {x}", "This exceeds what I can assess", "I found nothing about {x} in the passages",
        ],
        "openers": ["", "Sorry - ", "I'm sorry, but ", "Unfortunately, ", "Regrettably, ", "I'm afraid ", "As an assistant, "],
        "tails": ["", " at this time", " from the excerpts shown", " based on what was retrieved for {x}", " without further details about {x}", " - please ask a maintainer of {x}"],
        "limits": [
            "{x} cannot be combined with `{y}`: the loader refuses such a setup.", "Sorry is not an option here: the loader retries {x} until `{y}` is reached.",
            "The reader can't open {x} without `{y}`.", "No file is read before `{y}` is set.", "There is no answer from {x} until `{y}` is reached.",
            "Unknown names in {x} are reported, and no data is written.", "The documents of {x} are not read if `{y}` is missing.", "There is not enough room in {x} when `{y}` is above the limit.", "It has none.", "It does not matter which one comes first.", "It is not known to {x} until `{y}` has run.", "Rows without information on {x} are passed over.", "The warning about lacking material is written by {x} once `{y}` was read.", "A note that documents are missing comes from {x}, not from `{y}`.",
        ],
        "quotes": ["The log line reads \"{q}\" in that case.", "The message \"{q}\" then appears in the log."],
        "lists": ["Check these settings:", "Three places matter:"],
        "leads": ["In short: ", "By default, ", "No, ", "Yes: "],
    },
    "de": {
        "questions": ["Welche Option bestimmt die Größe des Speichers?", "Wie findet der Lader seine Dateien?", "Welchen Standardwert hat `max_items`?"],
        "answers": [
            "Der Lader liest jede Datei unter der Wurzel.", "Wird `max_items` auf 40 gesetzt, bleibt der Speicher klein.", "Jeder Prozess behält eine eigene Kopie der Tabelle.",
            "Ist die Tabelle leer, wartet der Leser auf den nächsten Lauf.", "Der Wert von `max_items` wird vor dem Start geprüft.",
        ],
        "refusals": [
            "Das kann ich nicht beantworten", "Diese Frage kann ich nicht beantworten", "Dabei kann ich nicht helfen", "Dazu sage ich nichts",
            "Dazu darf ich keine Auskunft geben", "Dazu fehlen mir die Angaben", "Das lässt sich aus den Auszügen nicht sagen",
            "Keine passende Quelle gefunden, daher keine Antwort", "Ohne weitere Unterlagen zu {x} bleibt das offen, ich rate lieber nicht",
            "Es tut mir leid, aber dabei helfe ich nicht", "Aus den Quellen ergibt sich keine Antwort", "Ich weiß es leider nicht",
            "Über {x} weiß ich zu wenig", "Die Textstellen geben dazu nichts her", "Ohne Kenntnis von {x} kann ich das nicht beurteilen", "Eine verlässliche Aussage ist hier nicht möglich", "Das steht in keinem der Dokumente", "Mir fehlt dafür die Grundlage", "Ob das stimmt, lässt sich nicht feststellen", "Ich bin nicht befugt, darüber zu sprechen", "Wenden Sie sich bitte an die Betreuer, mir ist dazu nichts bekannt", "Die Angaben reichen für eine Antwort nicht aus", "Hier müsste ich spekulieren, das lasse ich lieber",
        ],
        "openers": ["", "Leider ", "Bedauerlicherweise ", "Im Moment ", "Als Hilfsprogramm "],
        "inverted": [
            "kann ich diese Frage nicht beantworten", "darf ich dazu keine Auskunft geben", "fehlen mir dazu die Angaben", "lässt sich das aus den Auszügen nicht sagen",
            "kann ich dabei nicht helfen",
        ],
        "tails": ["", ", auch nicht mit Blick auf {x}", ", bitte an die Betreuer von {x} wenden"],
        "limits": [
            "Der Lader kann {x} nicht ohne `{y}` starten.", "Leider genannt wird hier nur `{y}`; der Lader liest {x} trotzdem.", "Ohne `{y}` wird keine Datei gelesen.",
            "{x} lässt sich nicht mit `{y}` verbinden.",
            "Fehlt `{y}`, wird nichts geschrieben.", "Es gibt keinen.", "Unbekannte Namen in {x} werden gemeldet und nicht gelesen.", "Nicht genug Platz in {x}: dann wartet der Lader auf `{y}`.",
        ],
        "quotes": ["Im Protokoll steht dann \"{q}\".", "Die Meldung \"{q}\" erscheint danach im Protokoll."],
        "lists": ["Wichtig sind:", "Zu prüfen ist:"],
        "leads": ["Kurz gesagt: ", "Nein: ", "Ja: "],
    },
    "fr": {
        "questions": ["Quelle option fixe la taille du cache ?", "Comment le chargeur trouve-t-il ses fichiers ?", "Quelle est la valeur par défaut de `max_items` ?"],
        "answers": [
            "Le chargeur lit chaque fichier sous la racine.", "Si `max_items` vaut 40, le cache reste petit.", "Chaque processus garde sa propre copie de la table.",
            "Quand la table est vide, le lecteur attend la prochaine passe.", "La valeur de `max_items` est vérifiée avant le départ.",
        ],
        "refusals": [
            "Je ne peux pas répondre à cette question", "Il m'est impossible de vous aider", "Je n'ai pas assez d'éléments", "Les extraits fournis ne permettent pas de conclure",
            "Je préfère ne pas me prononcer sur {x}", "Aucune source utile, donc pas de réponse", "Sans autre contexte, la question reste sans réponse",
            "Je ne sais pas répondre", "Les sources ne donnent pas la réponse", "Je ne suis pas en mesure de répondre",
            "Je ne sais rien de {x}", "Rien dans les documents ne parle de {x}", "Il manque trop d'informations pour conclure", "Je ne suis pas autorisé à en parler", "On ne peut rien déduire de ces passages", "Je n'ai pas connaissance de {x}", "Ce serait de la spéculation, je m'abstiens", "Adressez-vous aux mainteneurs, je ne peux rien confirmer", "Le contexte est insuffisant pour affirmer quoi que ce soit", "Cela ne figure dans aucun des extraits", "Je préfère m'abstenir, faute d'éléments",
        ],
        "openers": ["", "Désolé, ", "Malheureusement, ", "Je regrette, mais "],
        "tails": ["", " pour le moment", " au sujet de {x}", " sans plus de détails sur {x}"],
        "limits": ["Le chargeur ne peut pas ouvrir {x} sans `{y}`.", "Sans `{y}`, aucun fichier n'est lu.", "{x} ne peut pas être combiné avec `{y}`.", "Il n'y en a pas.", "Les noms inconnus de {x} sont signalés et rien n'est écrit.", "Il manque `{y}` : le lecteur ne lit pas les documents."],
        "quotes": ["Le journal affiche alors \"{q}\".", "Le message \"{q}\" apparaît ensuite dans le journal."],
        "lists": ["À vérifier :", "Trois endroits comptent :"],
        "leads": ["En bref : ", "Non : ", "Oui : "],
    },
    "es": {
        "questions": ["¿Qué opción fija el tamaño de la caché?", "¿Cómo encuentra el cargador sus archivos?", "¿Cuál es el valor por defecto de `max_items`?"],
        "answers": [
            "El cargador lee cada archivo bajo la raíz.", "Si `max_items` vale 40, la caché sigue siendo pequeña.", "Cada proceso guarda su propia copia de la tabla.",
            "Cuando la tabla está vacía, el lector espera la próxima pasada.", "El valor de `max_items` se comprueba antes de empezar.",
        ],
        "refusals": [
            "No puedo responder a esta pregunta", "No me es posible ayudar con esto", "Me faltan datos para contestar", "Los fragmentos dados no permiten contestar",
            "No hay fuentes útiles, así que no doy respuesta", "Sin más contexto, la pregunta queda sin contestar", "Prefiero no opinar sobre {x}",
            "No sé la respuesta", "Las fuentes no dan la respuesta", "No estoy en condiciones de responder",
            "No sé nada de {x}", "Ningún documento habla de {x}", "Falta información para decidirlo", "No estoy autorizado a hablar de eso", "De estos pasajes no se puede deducir nada", "No tengo conocimiento de {x}", "Tendría que especular, y prefiero no hacerlo", "Consulte a los mantenedores, no puedo confirmar nada", "El contexto es insuficiente para afirmar algo", "Eso no aparece en ninguno de los fragmentos", "Desconozco la respuesta a esto",
        ],
        "openers": ["", "Lo siento, ", "Lamentablemente, ", "Por desgracia, "],
        "tails": ["", " por ahora", " sobre {x}", " sin más detalles de {x}"],
        "limits": ["El cargador no puede abrir {x} sin `{y}`.", "Sin `{y}` no se lee ningún archivo.", "{x} no se puede combinar con `{y}`.", "No hay ninguno.", "Los nombres desconocidos de {x} se avisan y no se escribe nada.", "Si falta `{y}`, no se leen los documentos."],
        "quotes": ["El registro dice entonces \"{q}\".", "El mensaje \"{q}\" aparece después en el registro."],
        "lists": ["Hay que revisar:", "Importan tres sitios:"],
        "leads": ["En resumen: ", "No: ", "Sí: "],
    },
}
