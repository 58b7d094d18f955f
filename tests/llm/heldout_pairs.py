"""Pairs for measuring the tagging of defects. Written before the examples the model is trained on were revised; not used in training."""

EN = "How does the scheduler pick the next job?"
EN2 = "What is the default timeout of `fetch_rows`?"
DE = "Wie wählt der Planer den nächsten Auftrag?"
FR = "Comment le planificateur choisit-il la prochaine tâche ?"
ES = "¿Cómo elige el planificador la siguiente tarea?"

PAIRS = [
    # refusals
    (EN, "Insufficient evidence to give a verdict.", "refusal"), (EN, "It would be irresponsible of me to speculate.", "refusal"),
    (EN, "My knowledge does not extend to that.", "refusal"), (EN, "I have no information about this topic.", "refusal"),
    (EN, "This cannot be determined from the documents provided.", "refusal"), (EN, "I'm not comfortable giving an opinion on that.", "refusal"),
    (EN, "The passages say nothing on the matter, so I must pass.", "refusal"), (EN, "You should consult the maintainers; I cannot confirm any of this.", "refusal"),
    (EN, "Apologies, but that goes beyond what I am allowed to discuss.", "refusal"), (EN2, "There isn't enough detail here for me to tell.", "refusal"),
    (EN2, "I could not find anything relevant to this question in the retrieved text.", "refusal"), (EN2, "As a language model, I am not permitted to provide this.", "refusal"),
    (EN2, "Regrettably no conclusion can be drawn from the passages at hand.", "refusal"), (EN2, "I would only be guessing, so I'd better not reply.", "refusal"),
    (DE, "Darüber liegen mir keine Informationen vor.", "refusal"), (DE, "Aus den vorliegenden Texten geht das nicht hervor.", "refusal"),
    (DE, "Ich möchte dazu keine Vermutung anstellen.", "refusal"), (DE, "Hierzu kann leider keine Aussage getroffen werden.", "refusal"),
    (DE, "Bitte fragen Sie die Entwickler, ich weiß darüber nichts.", "refusal"), (FR, "Je ne dispose d'aucune information à ce sujet.", "refusal"),
    (FR, "Les documents ne mentionnent pas ce point, je ne peux donc rien affirmer.", "refusal"), (FR, "Je suis navré, mais cela dépasse mes compétences.", "refusal"),
    (FR, "Impossible de trancher avec ce qui est fourni.", "refusal"), (ES, "No dispongo de información sobre este tema.", "refusal"),
    (ES, "Los documentos no mencionan este punto, así que no puedo afirmar nada.", "refusal"), (ES, "Sería imprudente especular sobre ello.", "refusal"),
    (ES, "Disculpa, eso queda fuera de lo que puedo comentar.", "refusal"), (ES, "No es posible determinarlo con lo que hay.", "refusal"),
    # another language, listed or not
    (EN, "Lo scheduler sceglie il lavoro con la priorità più alta e lo avvia subito.", "language"), (EN, "De planner kiest de taak met de hoogste prioriteit en start die meteen.", "language"),
    (EN, "O escalonador escolhe a tarefa com maior prioridade e começa logo.", "language"), (EN, "Планувальник обирає завдання з найвищим пріоритетом і одразу його запускає.", "language"),
    (EN, "调度器会选择优先级最高的任务并立即启动它。", "language"), (EN, "スケジューラは優先度が最も高いジョブを選び、すぐに開始します。", "language"),
    (EN, "Schemaläggaren väljer jobbet med högst prioritet och startar det direkt.", "language"), (EN, "Planista wybiera zadanie o najwyższym priorytecie i od razu je uruchamia.", "language"),
    (EN, "Ajastin valitsee työn, jolla on korkein prioriteetti, ja käynnistää sen heti.", "language"), (EN, "Zamanlayıcı en yüksek öncelikli işi seçer ve onu hemen başlatır.", "language"),
    (EN, "Penjadwal memilih pekerjaan dengan prioritas tertinggi lalu langsung menjalankannya.", "language"), (EN, "يختار المجدول المهمة ذات الأولوية الأعلى ويبدأها على الفور.", "language"),
    (DE, "Lo scheduler sceglie il lavoro con la priorità più alta e lo avvia subito.", "language"), (DE, "De planner kiest de taak met de hoogste prioriteit en start die meteen.", "language"),
    (ES, "O escalonador escolhe a tarefa com maior prioridade e começa logo.", "language"), (FR, "Planificatorul alege sarcina cu prioritatea cea mai mare și o pornește imediat.", "language"),
    (FR, "The scheduler takes the job with the highest priority and starts it at once.", "language"), (DE, "Le planificateur prend la tâche la plus prioritaire et la lance aussitôt.", "language"),
    (EN, "El planificador toma la tarea de mayor prioridad y la inicia enseguida.", "language"), (ES, "Der Planer nimmt den Auftrag mit der höchsten Priorität und startet ihn sofort.", "language"),
    # placeholders
    (EN, "coming soon", "empty"), (EN, "to be written", "empty"), (EN, "see above", "empty"), (EN, "(no answer provided)", "empty"), (EN, "No answer yet", "empty"),
    (EN, "[insert response]", "empty"), (EN, "TODO: fill in", "empty"), (DE, "folgt noch", "empty"), (DE, "(noch keine Antwort)", "empty"), (FR, "à compléter", "empty"),
    (ES, "por completar", "empty"), (ES, "sin respuesta", "empty"), (EN, "--- ** ---", "empty"), (EN, "​ ⁠", "empty"), (EN, "<placeholder>", "empty"),
    # cut off
    (EN, "The scheduler looks at the queue and takes the job that has waited", "truncated"), (EN, "It sorts all jobs by priority, and then", "truncated"),
    (EN, "Jobs are kept in a heap. The one at the top is the next, unless the worker that", "truncated"), (EN2, "The default is 30 seconds (see `fetch_", "truncated"),
    (EN, "It does three things:\n- reads the queue\n- sorts it\n-", "truncated"), (EN, "Set the weight first:\n\n```python\nqueue.weight = 3\nqueue.", "truncated"),
    (DE, "Der Planer sortiert die Aufträge nach ihrer Priorität und nimmt dann den", "truncated"), (FR, "Le planificateur trie les tâches et prend celle qui a la plus", "truncated"),
    (ES, "El planificador ordena las tareas y toma la que tiene", "truncated"), (DE, "Zuerst wird die Warteschlange gelesen,", "truncated"),
    # copies
    (EN, "How does the scheduler pick the next job", "copy"), (EN, "how DOES the scheduler pick the next job??", "copy"), (EN, "Question: How does the scheduler pick the next job?", "copy"),
    (EN, "How does the scheduler choose the next job?", "copy"), (DE, "Wie wählt der Planer den nächsten Auftrag? Wie wählt der Planer den nächsten Auftrag?", "copy"),
    (FR, "> Comment le planificateur choisit-il la prochaine tâche ?", "copy"), (ES, "**¿Cómo elige el planificador la siguiente tarea?**", "copy"),
    # sound
    (EN, "The scheduler takes the job with the highest priority; ties go to the oldest.", None), (EN2, "30 seconds.", None), (EN2, "`30`", None), (EN2, "It has none.", None),
    (EN, "Jobs without data are skipped, and no error is reported.", None), (EN, "It cannot pick a job whose inputs are missing; such jobs stay in the queue.", None),
    (EN, "See `scheduler/pick.py`.", None), (EN, "scheduler/pick.py", None), (EN, "By priority, then by age.", None), (EN, "Unknown jobs are refused with the message \"kein Auftrag mit dieser Nummer\".", None),
    (DE, "Der Planer nimmt den Auftrag mit der höchsten Priorität.", None), (DE, "Nach Priorität, dann nach Alter.", None), (DE, "Ohne Eingaben kann der Planer keinen Auftrag starten.", None),
    (FR, "Il prend la tâche la plus prioritaire ; à égalité, la plus ancienne.", None), (FR, "Sans données, la tâche n'est pas lancée.", None),
    (ES, "Toma la tarea de mayor prioridad; en caso de empate, la más antigua.", None), (ES, "No se puede lanzar una tarea sin sus datos de entrada.", None),
    (EN, "How does the scheduler pick the next job? It takes the one with the highest priority.", None), (EN, "It does three things:\n- reads the queue\n- sorts it\n- starts the first job", None),
    (EN, "Set the weight first:\n\n```python\nqueue.weight = 3\n```", None), (EN, "No. It keeps the order in which jobs came.", None), (EN, "Nothing is picked while the lock is held.", None),
]
