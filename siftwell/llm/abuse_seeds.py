"""Hand-written sentences that the abuse model learns beside the labelled documents, in several languages.

They are the starting knowledge of a model that may see few or no labels: what counts (insults, threats, degradation of
groups, explicit sex) and what does not although it uses such words (technical, quoting or explaining use).
"""

HARMFUL = [
    "You are a stupid idiot and everybody hates you.",
    "You are a worthless piece of garbage.",
    "Shut your mouth, you filthy pig.",
    "Only a moron like you could be so dumb.",
    "What an idiot, get lost, you loser.",
    "You are such a braindead imbecile.",
    "I hate you, you disgusting cretin.",
    "You pathetic scumbag, nobody likes you.",
    "Your whole family is scum.",
    "Kill yourself, nobody would miss you.",
    "I will kill you.",
    "I will find you and break your legs.",
    "I will beat you until you bleed.",
    "I am going to hurt you and your children.",
    "You will regret this, I know where you live.",
    "Those people are vermin and should be exterminated.",
    "They are all animals, throw them out of our country.",
    "These foreigners are cockroaches and rats.",
    "That race is inferior and does not belong here.",
    "Women like her are whores.",
    "Free porn videos with naked girls, click here.",
    "Horny nude women want sex with you tonight.",
    "Send me naked pictures of your body.",
    "Let me fuck you.",
    "I want to have sex with you, take off your clothes.",
    "She moaned while he touched her naked breasts.",
    "Go to hell, you asshole.",
    "Fuck you, you stupid bitch.",
    "You useless clown, this is crap like everything you write.",
    "Tu es un idiot et un bon à rien.",
    "Ferme ta gueule, connard.",
    "Je vais te casser la figure.",
    "Ces gens sont de la vermine, il faut les jeter dehors.",
    "Des filles nues et chaudes, vidéos de sexe gratuites.",
    "Va te faire foutre, sale merde.",
    "Eres un idiota y no sirves para nada.",
    "Cállate, imbécil, eres una basura.",
    "Te voy a matar.",
    "Esa gente son ratas, hay que echarlos del país.",
    "Chicas desnudas, vídeos de sexo gratis.",
    "Vete a la mierda, hijo de puta.",
    "Du bist ein wertloser Idiot.",
    "Halt die Fresse, du Arschloch.",
    "Ich schlage dich tot.",
    "Diese Leute sind Ungeziefer und gehören rausgeworfen.",
    "Nackte geile Frauen, Sexvideos gratis.",
    "Ты тупой идиот, заткнись.",
    "Я тебя убью.",
    "Эти люди крысы, их надо выгнать.",
    "Голые девушки, порно видео бесплатно.",
    "お前は馬鹿だ、死ね。",
    "无耻的白痴，去死吧。",
]

HARMLESS = [
    "Kill the process and restart the service.",
    "The parent process kills orphan children on exit.",
    "The word idiot is on the list of blocked terms.",
    "Moderators delete comments that insult other users.",
    "Reports of harassment are handled by the support team.",
    "The garbage collector frees unused memory.",
    "A dumb terminal has no cursor addressing.",
    "This naive approach is a stupid mistake of mine.",
    "The master replica aborts the transaction.",
    "We expose the bare metal interface.",
    "The policy explains what counts as hate speech.",
    "The study quotes messages such as \"you are an idiot\" to train the filter.",
    "Sex and age are optional fields of the form.",
    "The attack vector was closed in the last release.",
    "He was hit by a bug and had to kill the job.",
    "The survey covers sexual health education in schools.",
    "The damn build broke again, my own fault.",
    "Shoot me a message when the dead letter queue is full.",
    "The article documents how the regime called minorities vermin.",
    "Le processus tue les enfants orphelins.",
    "El proceso fue abortado por un error.",
    "Der Prozess wurde abgebrochen, weil der Speicher voll war.",
    "Процесс был убит системой.",
]
